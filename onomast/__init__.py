"""Identifier resolution and corpus preparation on Spark."""

from onomast.functions.distance import hamming, levenshtein, similarity
from onomast.operators.artifact import Mapping, read, write
from onomast.operators.cluster import group_names
from onomast.operators.model import harmonize
from onomast.operators.profile import profile
from onomast.operators.propose import apply_mapping, harmonize_csv, propose, propose_csv

__version__ = "0.2.0"
__all__ = ["Mapping", "apply_mapping", "group_names", "hamming", "harmonize", "harmonize_csv", "levenshtein", "profile", "propose", "propose_csv", "read", "similarity", "write"]
