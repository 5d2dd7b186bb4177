"""Names proposed by a model, and the identity guard over them.

A proposer is any function from a list of names to ``{"canonical_pattern": str, "mapping": {name: canonical}}``, called once on the driver
with distinct names. Its answer is data: a group holds one signature and no substituted letter whatever it says.
"""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.functions import chars
from onomast.functions import names as N
from onomast.operators.cluster import split_on_substitution
from onomast.plans.shared import materialize

Proposer = Callable[[list[str]], dict]

DEFAULT_MODELS = {"openrouter": "openai/gpt-4o-mini", "ollama": "qwen3.5:9b"}
DEFAULT_URLS = {"openrouter": "https://openrouter.ai/api/v1", "ollama": "http://localhost:11434"}
LOCAL_TIMEOUT = 300
REMOTE_TIMEOUT = 60


def check_answer(answer: Any, names: list[str]) -> dict:
    """The answer with every name mapped: one that is missing maps to itself; a canonical form that is no text is refused."""
    if not isinstance(answer, dict) or not isinstance(answer.get("mapping"), dict):
        raise ValueError("the answer must be an object with an object 'mapping'")
    for name, canonical in answer["mapping"].items():
        if not isinstance(canonical, str) or not canonical.strip():
            raise ValueError(f"the canonical form of {name!r} is {canonical!r}; it must be a string that holds a character")
    pattern = answer.get("canonical_pattern", "")
    return {"canonical_pattern": pattern, "mapping": {n: n for n in names} | answer["mapping"]}


def rules_text() -> str:
    """The rules, in words, for a model's instructions."""
    expansions = "; ".join(f"{' and '.join(aliases)} become {c}" for c, aliases, _ in chars.ABBREVIATIONS)
    return "\n".join((
        "Write every name in lower case with underscores between its parts.",
        f"Expand abbreviations: {expansions}. Leave a part that you don't know.",
        "Write numbers without leading zeros and never change, drop or add one.",
        "Keep signs such as + and - where they stand; drop other punctuation.",
        'Answer with JSON only: {"canonical_pattern": "...", "mapping": {"<name>": "<canonical>"}}.',
    ))


def resolve_model(provider: str, model: str | None = None) -> str:
    """The model asked for, else the one that the environment names, else the provider's default."""
    return model or os.environ.get(f"{provider.upper()}_MODEL") or DEFAULT_MODELS[provider]


def resolve_url(provider: str, base_url: str | None = None) -> str:
    """The server asked for, else for ollama the one of OLLAMA_HOST (a scheme may be absent), else the provider's default."""
    host = os.environ.get("OLLAMA_HOST", "").strip() if provider == "ollama" else ""
    if host and "://" not in host:
        host = f"http://{host}"
    return (base_url or host or DEFAULT_URLS[provider]).rstrip("/")


def is_local(url: str) -> bool:
    """Whether a server is on this machine."""
    host = urllib.parse.urlsplit(url).hostname or ""
    return host in ("localhost", "::1") or host.startswith("127.")


def _post(url: str, body: dict, timeout: float, headers: dict | None = None) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | (headers or {}))
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)
    except (OSError, ValueError) as e:
        raise ValueError(f"{url} gave no usable answer ({e}); the methods rules and damerau need no server") from e


def _can_think(url: str, model: str, timeout: float) -> bool:
    try:
        return "thinking" in (_post(f"{url}/api/show", {"model": model}, timeout).get("capabilities") or ())
    except ValueError:
        return False


def http_proposer(provider: str = "openrouter", model: str | None = None, base_url: str | None = None, api_key: str | None = None, timeout: float | None = None) -> Proposer:
    """A proposer over an OpenAI-style or ollama chat endpoint. Names leave this process when it is called.

    A local model that can think is told not to, which takes minutes on a CPU; the field isn't valid for others."""
    if provider not in DEFAULT_MODELS:
        raise ValueError(f"unknown provider {provider!r}; one of {sorted(DEFAULT_MODELS)}")
    chosen, url = resolve_model(provider, model), resolve_url(provider, base_url)
    key = api_key or os.environ.get("OPENROUTER_API_KEY")

    def propose(names: list[str]) -> dict:
        if provider == "openrouter" and not key:  # a method may find that it needs no model
            raise ValueError("no API key: set OPENROUTER_API_KEY, or use the method rules or damerau")
        messages = [{"role": "system", "content": rules_text()}, {"role": "user", "content": json.dumps(names, ensure_ascii=False)}]
        if provider == "ollama":
            wait = timeout or LOCAL_TIMEOUT
            body = {"model": chosen, "messages": messages, "format": "json", "stream": False, "options": {"temperature": 0}}
            raw = _post(f"{url}/api/chat", body | ({"think": False} if _can_think(url, chosen, wait) else {}), wait)
        else:
            body = {"model": chosen, "messages": messages, "temperature": 0, "response_format": {"type": "json_object"}}
            raw = _post(f"{url}/chat/completions", body, timeout or REMOTE_TIMEOUT, {"Authorization": f"Bearer {key}"})
        try:
            content = (raw if provider == "ollama" else raw["choices"][0])["message"]["content"]
            answer = json.loads(content)
        except (KeyError, IndexError, TypeError, ValueError) as e:
            raise ValueError(f"{url} answered without a JSON message") from e
        return check_answer(answer, names)

    return propose


def harmonize(names: list[str], proposer: Proposer | None = None, **options) -> dict:
    """The pattern and the names that a model proposes for distinct names, without any guard; asks over HTTP unless given a proposer."""
    distinct = list(dict.fromkeys(names))
    if not distinct:
        return {"canonical_pattern": "", "mapping": {}}
    return check_answer((proposer or http_proposer(**options))(distinct), distinct)


def guard(names: DataFrame, answer: DataFrame, representative: DataFrame | None = None) -> DataFrame:
    """Groups from a model's answer, split until each has one identity.

    ``names``: feature rows (name, signature, norm, skeleton, letters). ``answer``: ``name, canonical``, of the names or, with
    ``representative`` (``name, rep``), of representatives; a name answered more than once takes the least of its answers. Returns
    ``name, group, proposed`` with features, a row for each name."""
    answer = answer.groupBy("name").agg(F.min("canonical").alias("canonical"))
    spoken = names if representative is None else None
    if spoken is None:
        reps = representative.select(F.col("rep").alias("name")).distinct()
        spoken = reps.withColumns(N.features(F.col("name")))
    asked = spoken.join(answer, "name", "left").withColumn("canonical", F.coalesce("canonical", "name"))
    asked = materialize(asked.withColumn("block", F.xxhash64("canonical", F.array_join("signature", "\0"), F.size("signature"))), "asked")
    parts = split_on_substitution(asked, "block")
    whole = parts.groupBy("block").agg(F.count_distinct("part").alias("pieces"))
    first = parts.groupBy("block", "part").agg(F.min("name").alias("first"))
    parts = parts.join(whole, "block").join(first, ["block", "part"])
    head = parts.where("name = first").select("block", "part", F.col("skeleton").alias("head_skeleton"))
    parts = parts.join(head, ["block", "part"])
    unsplit = (F.col("pieces") == 1) | (F.col("head_skeleton") == N.skeleton(F.col("canonical")))
    judged = parts.select("name", F.xxhash64("block", "part").alias("piece"), "canonical", F.col("signature").alias("spoken"), unsplit.alias("unsplit"))
    if representative is None:
        rows = names.join(judged, "name").withColumn("identity", F.col("piece"))
        rows = rows.withColumn("final_part", F.lit(""))
    else:
        rows = names.join(representative, "name").join(judged.withColumnRenamed("name", "rep"), "rep").drop("rep")
        rows = rows.withColumn("identity", F.xxhash64("piece", F.array_join("signature", "\0"), F.size("signature")))
        rows = split_on_substitution(materialize(rows, "gathered"), "identity").withColumnRenamed("part", "final_part")
    rows = materialize(rows, "guarded")
    groups = rows.groupBy("identity", "final_part").agg(F.min("name").alias("group"))
    rows = rows.join(groups, ["identity", "final_part"])
    named = rows.where(F.col("name") == F.col("group"))
    target = N.signature(F.col("canonical"))
    fits = F.col("unsplit") & (F.col("spoken") == target) & (F.col("signature") == target)
    own = F.when(F.col("norm") != "", F.col("norm")).otherwise(F.col("name"))
    proposed = named.select("group", F.when(fits, F.col("canonical")).otherwise(own).alias("proposed"))
    return rows.select("name", "group", "signature", "norm", "skeleton", "letters").join(proposed, "group")
