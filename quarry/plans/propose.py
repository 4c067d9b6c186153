"""Proposals of candidate features: replayed from files, asked of a command or an endpoint, or drawn at random. A proposer never sees rows:
its card holds names and summaries only."""

from __future__ import annotations

import json
import re
import shlex
import subprocess
import tempfile
import urllib.request
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.expr import STRICT, ExpressionError, compile_expression, order_by_dependency
from quarry.plans.schema import profile
from quarry.sources.io import ResponseCache, canonical_hash

FAMILIES = ("ratios", "interactions", "thresholds", "dispersion", "encodings")
PER_FAMILY, KEEP = 8, 36
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]{0,79}")


def column_card(df: DataFrame, columns: Sequence[str], top: Sequence[str] = (), pairs: Sequence[tuple[str, str]] = ()) -> dict:
    """What a proposer may know: a summary a column, the probe model's top columns and pairs."""
    rows = profile(df, list(columns)).collect()  # a row a column
    n = df.count()
    facts = {r["column"]: {"missing_rate": r["n_missing"] / max(n, 1), "n_unique": r["n_unique"], "min": r["minimum"], "median": r["median"], "max": r["maximum"]} for r in rows}
    return {"columns": facts, "top_columns": list(top), "top_pairs": [list(p) for p in pairs]}


def parse_answer(text: str) -> dict:
    """The JSON object of an answer, with or without a code fence or words around it."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for candidate in [fenced[1]] if fenced else [text, text[text.find("{") : text.rfind("}") + 1]]:
        try:
            got = json.loads(candidate)
            if isinstance(got, dict):
                return got
        except ValueError:
            continue
    raise ValueError("the answer holds no JSON object")


class Proposer:
    """mode: "replay" (a cache folder), "command" (a program: prompt in, answer out), "api" (an HTTP endpoint for chats)."""

    def __init__(self, mode: str = "replay", cache: str | None = None, command: str = "", url: str = "", key: str = "", model: str = "", timeout: float = 900):
        if mode not in ("replay", "command", "api") or mode == "command" and not command or mode == "api" and not url or mode == "replay" and not cache:
            raise ValueError(f"settings of mode {mode!r} are incomplete")
        self.mode, self.command, self.url, self.key, self.model, self.timeout = mode, command, url, key, model, timeout
        self.cache = ResponseCache(cache) if cache else None

    def ask(self, request: dict, schema: dict | None = None) -> dict:
        if self.cache and (held := self.cache.get(request)) is not None:
            return held
        if self.mode == "replay":
            raise LookupError(f"no recorded answer for request {canonical_hash(request)[:12]}")
        prompt = json.dumps(request, sort_keys=True)
        answer = parse_answer(self._run(prompt, schema) if self.mode == "command" else self._post(prompt))
        if self.cache:
            self.cache.put(request, answer)
        return answer

    def _run(self, prompt: str, schema: dict | None) -> str:
        with tempfile.TemporaryDirectory() as folder:
            out, shape = Path(folder, "answer"), Path(folder, "schema.json")
            shape.write_text(json.dumps(schema or {}), encoding="utf-8")
            parts = [p.replace("{output}", str(out)).replace("{schema}", str(shape)) for p in shlex.split(self.command)]
            done = subprocess.run(parts, input=prompt, capture_output=True, text=True, timeout=self.timeout, check=True)
            return out.read_text(encoding="utf-8") if out.exists() else done.stdout

    def _post(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}]}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            return json.load(r)["choices"][0]["message"]["content"]


def propose(proposer: Proposer, card: dict, families: Sequence[str] = FAMILIES, keep: int = KEEP) -> list[dict]:
    """At most 8 features a family, the first ``keep`` of all in the order of the calls: [{"name", "expression", "family"}]."""
    out = []
    for family in families:
        answer = proposer.ask({"task": "features", "family": family, "card": card, "most": PER_FAMILY})
        out += [{"name": f.get("name", ""), "expression": f.get("expression", ""), "family": family} for f in answer.get("features", [])[:PER_FAMILY]]
    return out[:keep]


def load_frozen(path: str, dataset: str | None = None) -> list[dict]:
    """A recorded set of features {"dataset", "features", "sha256"}, checked."""
    held = json.loads(Path(path).read_text(encoding="utf-8"))
    if canonical_hash(held["features"]) != held["sha256"]:
        raise ValueError(f"{path}: the features do not match their checksum")
    if dataset and held.get("dataset") != dataset:
        raise ValueError(f"{path} was recorded for {held.get('dataset')}")
    return held["features"]


def save_frozen(features: list[dict], path: str, dataset: str) -> None:
    Path(path).write_text(json.dumps({"dataset": dataset, "features": features, "sha256": canonical_hash(features)}, indent=1), encoding="utf-8")


def audit(df: DataFrame, proposals: Sequence[dict], label: str, part: str = "_part", cap: int = KEEP, dialect: str = STRICT) -> tuple[dict[str, str], list[dict]]:
    """Proposals that are valid (name to expression), and a reason for every proposal.

    Syntax is judged on the driver; then one pass over the rows says, of all candidates at once, whether each is finite on
    parts I and V and not constant. Beyond ``cap`` valid ones the reason is "over budget".
    """
    columns, pool, reasons = set(df.columns), {}, []
    for p in proposals:
        name, why = str(p.get("name", "")), ""
        if not _NAME.fullmatch(name):
            why = "name not allowed"
        elif name in pool or name in columns:
            why = "name taken"
        else:
            try:
                compile_expression(p["expression"], columns | set(pool), label, dialect)
                pool[name] = p["expression"]
            except (ExpressionError, KeyError) as e:
                why = str(e)
        reasons.append({"name": name, "reason": why})
    valid: dict[str, str] = {}
    if pool:
        from quarry.functions.expr import with_expressions

        rows = with_expressions(df.where(F.col(part).isin("I", "V")) if part in columns else df, pool, label=label, dialect=dialect)
        aggs = [x for i, n in enumerate(pool) for x in (F.count_if(F.col(n).isNull()).alias(f"z{i}"), F.min(n).alias(f"a{i}"), F.max(n).alias(f"b{i}"))]
        got = rows.agg(*aggs).first()
        said = {r["name"]: r for r in reasons}
        for i, n in enumerate(pool):
            if got[f"z{i}"]:
                said[n]["reason"] = "not finite everywhere"
            elif got[f"a{i}"] == got[f"b{i}"]:
                said[n]["reason"] = "constant"
            elif len(valid) >= cap:
                said[n]["reason"] = "over budget"
            else:
                needs = [m for m in order_by_dependency([n], pool, columns, dialect) if m != n]
                if all(m in valid for m in needs):
                    valid[n] = pool[n]
                    said[n]["reason"] = "valid"
                else:
                    said[n]["reason"] = "depends on a feature that is not valid"
    return valid, reasons
