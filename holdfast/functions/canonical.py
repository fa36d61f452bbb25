"""Canonical JSON and its digests, for free-form records and for validated specs and patterns."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.features import OPS


def canonical(record: object) -> str:
    """Sorted keys, no spaces, characters unescaped; not-a-number is refused."""
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(record: object) -> str:
    return hashlib.sha256(canonical(record).encode()).hexdigest()


def _without(text: str | None, drop: tuple[str, ...]) -> str | None:
    try:
        record = json.loads(text)
        if drop:
            record = {k: v for k, v in record.items() if k not in drop}
        return digest(record)
    except (TypeError, ValueError, AttributeError):
        return None


def canonical_digest(text: Column, drop: tuple[str, ...] = ()) -> Column:
    """Digest of a JSON text without its top-level keys ``drop``; null where it is no JSON. Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _without(t, drop))

    return run(text)


def canonical_text(text: Column) -> Column:
    """Canonical form of a JSON text; null where it is no JSON. Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_canonical_or_none)

    return run(text)


def _canonical_or_none(text: str | None) -> str | None:
    try:
        return canonical(json.loads(text))
    except (TypeError, ValueError):
        return None


def streamed_digest(parts: DataFrame, key: list[str], order: list[str], first: str = "", last: str = "") -> DataFrame:
    """(key..., digest): SHA-256 of ``first``, the texts of each key and ``last``. ``parts`` has the key, a number
    ``place``, the columns ``order`` and ``text``; texts come in order of place and ``order``, and those of one place are
    parted by commas. Spark sorts the rows and tasks hash them as they pass, so no key's texts are gathered."""
    kinds = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in key)

    def run(batches):
        import pyarrow as pa

        schema, state = None, None  # state: key, hash so far, place of the last text
        for batch in batches:
            schema = pa.schema([batch.schema.field(c) for c in key] + [pa.field("digest", pa.string())])
            done = []
            rows = zip(zip(*(batch.column(c).to_pylist() for c in key)), batch.column("place").to_pylist(), batch.column("text").to_pylist())
            for own, place, text in rows:
                if state is None or state[0] != own:
                    if state is not None:
                        done.append(state)
                    state = [own, hashlib.sha256(first.encode()), None]
                if state[2] == place:
                    state[1].update(b",")
                state[1].update(text.encode())
                state[2] = place
            if done:
                yield _closed(done, schema, last)
        if state is not None:
            yield _closed([state], schema, last)

    placed = parts.repartition(*key).sortWithinPartitions(*key, "place", *order).select(*key, "place", "text")
    return placed.mapInArrow(run, f"{kinds}, digest string")


def _closed(states, schema, last):
    import pyarrow as pa

    for s in states:
        s[1].update(last.encode())
    columns = [pa.array(values, field.type) for values, field in zip(zip(*(s[0] for s in states)), schema)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([s[1].hexdigest() for s in states])], schema=schema)


# The keys of a spec.
_SPEC_KEYS = {"schema_version", "name", "graph", "deps", "cost", "output_schema"}


def normalized_spec(body: dict, versions: dict[str, str]) -> dict:
    """A spec with nodes in order of ids, different deps in order and the versions of its operations; raises on
    other keys, repeated or unknown nodes, unknown operations and circles."""
    if set(body) - {"spec_id"} != _SPEC_KEYS:
        raise ValueError("keys")
    nodes = {n["id"]: n for n in body["graph"]["nodes"]}
    if len(nodes) != len(body["graph"]["nodes"]):
        raise ValueError("repeated node")
    if body["graph"]["output"] not in nodes:
        raise ValueError("unknown output")
    done: dict[str, bool] = {}

    def visit(name: str) -> None:
        if name not in nodes:
            raise ValueError("unknown input")
        if done.get(name) is False:
            raise ValueError("circle")
        if name not in done:
            done[name] = False
            for i in nodes[name].get("inputs", []):
                visit(i)
            done[name] = True

    for name in nodes:
        if nodes[name]["op"] not in versions:
            raise ValueError("unknown op")
        visit(name)
    graph = {"nodes": [{**nodes[n], "version": versions[nodes[n]["op"]]} for n in sorted(nodes)], "output": body["graph"]["output"]}
    return {**{k: body[k] for k in _SPEC_KEYS}, "graph": graph, "deps": sorted(set(body["deps"]))}


def spec_ids(bodies: Column) -> Column:
    """struct(spec_id, error) of spec documents: the digest, or what is wrong; a stated id must agree."""
    versions = {"raw_get": "1", "llm_call": "1", **{k: v.version for k, v in OPS.items()}}

    @F.pandas_udf("spec_id string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                body = json.loads(t)
                own = digest(normalized_spec(body, versions))
                out.append((None, "other id") if body.get("spec_id", own) != own else (own, None))
            except (TypeError, KeyError, ValueError, AttributeError) as e:
                out.append((None, str(e).strip("'") or "malformed"))
        return pd.DataFrame(out, columns=["spec_id", "error"])

    return run(bodies)


# The keys of a pattern.
_PATTERN_KEYS = {"spec_ref", "assertion", "scope", "observation_window", "replication_protocol"}


def pattern_ids(bodies: Column) -> Column:
    """struct(pattern_id, error) of pattern documents {spec_ref, assertion, scope, observation_window,
    replication_protocol}; a stated id must agree."""

    @F.pandas_udf("pattern_id string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                body = json.loads(t)
                stated = body.pop("pattern_id", None)
                if set(body) != _PATTERN_KEYS:
                    raise ValueError("keys")
                if len(body["spec_ref"]) != 64 or body["assertion"]["kind"] not in ("in_range", "quantile_ge", "sign"):
                    raise ValueError("spec or assertion")
                own = digest({**body, "versions": {"assertion": "1", "scope": "1"}})
                out.append((None, "other id") if stated not in (None, own) else (own, None))
            except (TypeError, KeyError, ValueError, AttributeError) as e:
                out.append((None, str(e).strip("'") or "malformed"))
        return pd.DataFrame(out, columns=["pattern_id", "error"])

    return run(bodies)


def prompt_hash(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def params_hash(model: Column, params: Column) -> Column:
    """Digest of {"model": ..., "params": ...}; ``params`` is canonical JSON already."""
    return F.sha2(F.concat(F.lit('{"model":"'), model, F.lit('","params":'), params, F.lit("}")), 256)


def register(specs: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Specs to add (spec_id, body) and conflicts: ids that come with different bodies."""
    everything = specs.select("spec_id", "body") if existing is None else specs.select("spec_id", "body").union(existing.select("spec_id", "body"))
    conflicts = everything.groupBy("spec_id").agg(F.count_distinct("body").alias("bodies")).where("bodies > 1")
    good = specs.select("spec_id", "body").dropDuplicates(["spec_id", "body"]).join(conflicts, "spec_id", "left_anti")
    return (good if existing is None else good.join(existing.select("spec_id"), "spec_id", "left_anti")), conflicts
