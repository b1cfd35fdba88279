"""Profiles and registries of configs: nested YAML or JSON documents as typed rows, with their rules as columns.

A document is one row. Parsing YAML is all that Python does: it gives the document as JSON and the paths of its fields, so that unknown fields at any depth
are a difference of arrays, wrong types are what the JSON reader can't convert, and rules are expressions over the typed fields. Files that a
profile names are looked up by a join with the files that are there.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from vocalith.sources.schemas import violations

PROFILE_DOC = (
    "use_case STRUCT<name: STRING, domain: STRING, channel: STRING, languages: ARRAY<STRING>, expected_accents: ARRAY<STRING>, avg_call_minutes: DOUBLE, agent_talk_ratio: DOUBLE>, "
    "constraints STRUCT<stack: STRUCT<max_p95_ttfa_ms: DOUBLE, max_cost_per_min_usd: DOUBLE, min_task_success_rate: DOUBLE, require_baa: BOOLEAN, data_residency: ARRAY<STRING>, deployment: STRING, min_concurrency: BIGINT>, "
    "stt: STRUCT<min_entity_recall: MAP<STRING, DOUBLE>, max_wer: DOUBLE>, turn_taking: STRUCT<max_premature_endpoint_rate: DOUBLE, max_p95_endpoint_delay_ms: DOUBLE>, "
    "llm: STRUCT<min_check_pass_rate: MAP<STRING, DOUBLE>, max_p95_ttft_ms: DOUBLE, require_tool_calling: BOOLEAN>, tts: STRUCT<max_p95_ttfb_ms: DOUBLE, max_roundtrip_wer: DOUBLE, min_entity_pronunciation: DOUBLE, voice: ARRAY<STRING>>>, "
    "entities ARRAY<STRUCT<name: STRING, kind: STRING, lexicon_path: STRING, pattern: STRING, builtin: STRING>>, keyterms ARRAY<STRING>, keyterms_path STRING, conversation_scripts STRING, "
    "synthetic_templates STRING, audio STRUCT<manifest_path: STRING>, reference_suite STRING"
)
CONFIG = (
    "config_id: STRING, provider: STRING, model_id: STRING, mode: STRING, settings: MAP<STRING, STRING>, pricing: STRUCT<amount: DOUBLE, unit: STRING, billing_basis: STRING, source: STRING, as_of: DATE>, "
    "baa: STRUCT<status: STRING, source: STRING>, env_key: STRING, base_url: STRING, output_date_order: STRING, verify: BOOLEAN, notes: STRING"
)
REGISTRY_DOC = f"configs ARRAY<STRUCT<{CONFIG}>>"
# Patterns of names, and the values that fields of few values have.
LANGUAGE, ENTITY_NAME, ID, ENV_KEY, BASE_URL = r"^[a-z]{2,3}(-[A-Za-z0-9]{2,8})*$", r"^[a-z][a-z0-9_]*$", r"^[a-z0-9][a-z0-9_]*$", r"^[A-Z][A-Z0-9_]*$", r"^https://[^/\s]+(/[^\s]*)?$"
CHANNELS, DEPLOYMENTS = ("telephony_8k", "wideband_16k"), ("managed", "self_hosted", "either")
KINDS = {"lexicon": "lexicon_path", "regex": "pattern", "builtin": "builtin"}
BUILTIN_NAMES = ("number", "date", "dosage", "phone", "duration")
MODES, UNITS, BASES, BAA = ("batch", "streaming"), ("minute", "hour"), ("audio_duration", "session_duration", "per_channel"), ("yes", "no", "unknown")

_PARSED = "struct<body:string,fields:array<string>,error:string>"


def _paths(value: object, at: str = "") -> set[str]:
    """Paths of the fields in a document; items of lists share theirs."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in ({f"{at}.{k}".lstrip(".")} | _paths(v, f"{at}.{k}".lstrip(".")))}
    return {p for v in value for p in _paths(v, at)} if isinstance(value, list) else set()


def known_fields(kind: DataType, at: str = "") -> tuple[set[str], set[str]]:
    """(paths, open ones) of a schema's fields; whatever lies below an open one is known."""
    if isinstance(kind, ArrayType):
        return known_fields(kind.elementType, at)
    if isinstance(kind, MapType):
        return set(), {at}
    known, free = set(), set()
    for f in kind.fields if isinstance(kind, StructType) else ():
        path = f"{at}.{f.name}".lstrip(".")
        a, b = known_fields(f.dataType, path)
        known |= {path} | a
        free |= b
    return known, free


def _parse(text: Column) -> Column:
    @F.pandas_udf(_PARSED)
    def run(some: pd.Series) -> pd.DataFrame:
        import yaml

        out = []
        for t in some:
            try:
                doc = yaml.safe_load(t)
                if not isinstance(doc, dict):
                    raise ValueError("not a mapping")
                out.append((json.dumps(doc, default=str), sorted(_paths(doc)), None))
            except (yaml.YAMLError, ValueError) as e:
                out.append((None, [], str(e).splitlines()[0]))
        return pd.DataFrame(out, columns=["body", "fields", "error"])

    return run.asNondeterministic()(text)


def read_documents(spark: SparkSession, path: str, schema: str, ending: str = "*.y*ml") -> DataFrame:
    """(file, folder, error, unknown, bad, d): a document a file below ``path``. ``error`` tells what can't be parsed, ``unknown`` has fields that
    the schema lacks, ``bad`` is the document where a value has another type."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", ending).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    known, free = known_fields(StructType.fromDDL(schema))
    p = files.withColumn("p", _parse(F.col("value")))
    inside = lambda f: F.exists(F.array(*map(F.lit, sorted(free))).cast("array<string>"), lambda x: F.startswith(f, F.concat(x, F.lit("."))))
    unknown = F.filter("p.fields", lambda f: ~F.array_contains(F.array(*map(F.lit, sorted(known))), f) & ~inside(f))
    # a corrupt record beside the fields, which Spark's reader fills in where a value doesn't convert
    doc = F.from_json("p.body", StructType.fromDDL(f"{schema}, _bad STRING"), {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    return p.select("file", F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("folder"), F.col("p.error").alias("error"), unknown.alias("unknown"), doc.alias("d")).withColumn("bad", F.col("d._bad"))


def _rate(c: Column) -> Column:
    return c.isNotNull() & ~c.between(0, 1)


def _positive(c: Column) -> Column:
    return c.isNotNull() & ~(c > 0)


def _none_of(c: Column, values: tuple[str, ...], optional: bool = True) -> Column:
    return (c.isNotNull() if optional else F.lit(True)) & ~F.coalesce(c.isin(*values), F.lit(False))


def _document_rules() -> dict[str, Column]:
    return {"unreadable": F.col("error").isNotNull(), "unknown_field": F.size("unknown") > 0, "wrong_type": F.col("bad").isNotNull()}


def profile_rules() -> Mapping[str, Column]:
    """Rules of rows of ``read_documents`` with ``PROFILE_DOC``; a document that can't be read, or has other fields or types, breaks only these rules."""
    d = lambda x: F.col(f"d.{x}")
    use, e = (lambda x: d(f"use_case.{x}")), F.coalesce(d("entities"), F.array().cast(StructType.fromDDL(PROFILE_DOC)["entities"].dataType))
    own = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v)])
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    count = lambda x: sum((x[f].isNotNull().cast("int") for f in KINDS.values()), F.lit(0))
    filled = lambda x: F.coalesce(*[F.when((x["kind"] == k) & x[f].isNotNull(), True) for k, f in KINDS.items()], F.lit(False))
    names = F.transform(e, lambda x: x["name"])
    rates = ("stack.min_task_success_rate", "stt.max_wer", "turn_taking.max_premature_endpoint_rate", "tts.max_roundtrip_wer", "tts.min_entity_pronunciation")
    times = ("stack.max_p95_ttfa_ms", "stack.max_cost_per_min_usd", "turn_taking.max_p95_endpoint_delay_ms", "llm.max_p95_ttft_ms", "tts.max_p95_ttfb_ms")
    recall = F.coalesce(d("constraints.stt.min_entity_recall"), F.create_map().cast("map<string,double>"))
    checks = F.coalesce(d("constraints.llm.min_check_pass_rate"), F.create_map().cast("map<string,double>"))
    either = lambda cs: F.coalesce(*[F.when(c, True) for c in cs], F.lit(False))
    rules = {
        "use_case_incomplete": empty(use("name")) | empty(use("domain")) | use("channel").isNull() | use("avg_call_minutes").isNull() | use("agent_talk_ratio").isNull() | (F.coalesce(F.size(use("languages")), F.lit(0)) < 1),
        "channel": _none_of(use("channel"), CHANNELS), "language": F.exists(F.coalesce(use("languages"), F.array().cast("array<string>")), lambda x: ~F.coalesce(x.rlike(LANGUAGE), F.lit(False))),
        "not_positive": either([_positive(use("avg_call_minutes")), *[_positive(d(f"constraints.{x}")) for x in times], _positive(d("constraints.stack.min_concurrency"))]),
        "not_a_rate": either([_rate(use("agent_talk_ratio")), *[_rate(d(f"constraints.{x}")) for x in rates], *[F.exists(F.map_values(m), _rate) for m in (recall, checks)]]),
        "deployment": _none_of(d("constraints.stack.deployment"), DEPLOYMENTS),
        "entity_name": F.exists(e, lambda x: ~F.coalesce(x["name"].rlike(ENTITY_NAME), F.lit(False))),
        "entity_kind": F.exists(e, lambda x: F.element_at(own, x["kind"]).isNull()),
        "entity_builtin": F.exists(e, lambda x: _none_of(x["builtin"], BUILTIN_NAMES)),
        "entity_without_source": F.exists(e, lambda x: F.element_at(own, x["kind"]).isNotNull() & ~filled(x)), "entity_with_other_source": F.exists(e, lambda x: filled(x) & (count(x) > 1)),
        "duplicate_entities": F.size(F.array_distinct(names)) < F.size(names), "two_key_term_lists": d("keyterms").isNotNull() & d("keyterms_path").isNotNull(),
        "recall_of_unknown_entity": F.size(F.array_except(F.map_keys(recall), names)) > 0, "empty_manifest": d("audio").isNotNull() & empty(d("audio.manifest_path")),
    }
    own_rules = _document_rules()
    whole = ~either(own_rules.values())
    return own_rules | {k: whole & v for k, v in rules.items()}


def registry_rules() -> Mapping[str, Column]:
    """Rules of rows of ``read_documents`` with ``REGISTRY_DOC``, over all configs of a document."""
    c = F.coalesce(F.col("d.configs"), F.array().cast(StructType.fromDDL(REGISTRY_DOC)["configs"].dataType))
    some = lambda f: F.exists(c, f)
    lacks = lambda x, pattern: ~F.coalesce(x.rlike(pattern), F.lit(False))
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    ids = F.transform(c, lambda x: x["config_id"])
    status = lambda x: F.coalesce(x["baa"]["status"], F.lit("unknown"))
    rules = {
        "no_configs": F.col("d.configs").isNull(), "config_id": some(lambda x: lacks(x["config_id"], ID)), "provider": some(lambda x: lacks(x["provider"], ID)), "model_id": some(lambda x: empty(x["model_id"])),
        "mode": some(lambda x: _none_of(x["mode"], MODES, False)), "env_key": some(lambda x: lacks(x["env_key"], ENV_KEY)), "base_url": some(lambda x: x["base_url"].isNotNull() & lacks(x["base_url"], BASE_URL)),
        "date_order": some(lambda x: _none_of(x["output_date_order"], ("mdy", "dmy"))), "price": some(lambda x: _positive(x["pricing"]["amount"])),
        "pricing": some(lambda x: _none_of(x["pricing"]["unit"], UNITS, False) | _none_of(x["pricing"]["billing_basis"], BASES, False) | empty(x["pricing"]["source"]) | x["pricing"]["as_of"].isNull()),
        "baa": some(lambda x: _none_of(status(x), BAA)), "baa_without_source": some(lambda x: (status(x) != "unknown") & empty(x["baa"]["source"])),
        "verified_without_price": some(lambda x: (F.coalesce(x["verify"], F.lit(True)) == F.lit(False)) & x["pricing"]["amount"].isNull()), "duplicate_configs": F.size(F.array_distinct(ids)) < F.size(ids),
    }
    own = _document_rules()
    whole = ~F.coalesce(*[F.when(v, True) for v in own.values()], F.lit(False))
    return own | {k: whole & v for k, v in rules.items()}


def patterns_that_fail(docs: DataFrame) -> DataFrame:
    """(file, rule) of profiles whose entities have a pattern that doesn't compile."""

    @F.pandas_udf("boolean")
    def compiles(some: pd.Series) -> pd.Series:
        import re

        def fine(p: str | None) -> bool:
            try:
                re.compile(p or "")
                return True
            except re.error:
                return False

        return some.map(fine)

    each = docs.select("file", F.explode("d.entities").alias("e")).select("file", F.col("e.pattern").alias("pattern")).where("pattern IS NOT NULL")
    return each.where(~compiles("pattern")).select("file", F.lit("entity_pattern").alias("rule")).distinct()


def references(docs: DataFrame) -> DataFrame:
    """(file, field, path) of every file that a profile names; relative ones lie beside it."""
    lexicons = F.transform(F.coalesce(F.col("d.entities"), F.array().cast(StructType.fromDDL(PROFILE_DOC)["entities"].dataType)), lambda e: F.struct(F.concat(F.lit("entities."), e["name"], F.lit(".lexicon_path")).alias("field"), e["lexicon_path"].alias("path")))
    others = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"d.{f}").alias("path")) for f in ("keyterms_path", "conversation_scripts", "synthetic_templates", "audio.manifest_path")])
    each = docs.select("file", "folder", F.explode(F.concat(lexicons, others)).alias("r")).select("file", "folder", "r.*").where("path <> ''")
    plain = F.regexp_replace("path", r"^\./", "")
    place = F.when(F.col("path").rlike(r"^(/|[a-z]+:/)"), F.col("path")).otherwise(F.concat("folder", F.lit("/"), plain))
    return each.select("file", "field", F.regexp_replace(place, r"^(file:)?/+", "/").alias("path"))


def there(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the files below ``root``, none of which is opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", r"^(file:)?/+", "/").alias("path"))


def profile_violations(spark: SparkSession, path: str) -> DataFrame:
    """(file, rule) of all profiles below ``path``: their own rules, patterns, and files that aren't there."""
    docs = read_documents(spark, path, PROFILE_DOC)
    gone = references(docs).join(there(spark, path), "path", "left_anti").select("file", F.concat(F.lit("missing_file "), "field").alias("rule"))
    return violations(docs, profile_rules(), key="file", unique=False).union(patterns_that_fail(docs)).union(gone)


def registry_violations(spark: SparkSession, path: str) -> DataFrame:
    return violations(read_documents(spark, path, REGISTRY_DOC), registry_rules(), key="file", unique=False)


def boost_terms(spark: SparkSession, path: str) -> DataFrame:
    """(file, source, term): each profile's key terms in the order of precedence: its own list, its file, else all terms of its lexicons."""
    docs = read_documents(spark, path, PROFILE_DOC)
    term = F.lower(F.trim("value"))
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.regexp_replace(F.col("_metadata.file_path"), r"^(file:)?/+", "/").alias("path"), term.alias("term")).where((term != "") & ~term.startswith("#"))
    own = docs.select("file", F.lit("keyterms").alias("source"), F.explode("d.keyterms").alias("term"))
    named = docs.select("file", F.col("d.keyterms").isNotNull().alias("a"), F.col("d.keyterms_path").isNotNull().alias("b"))
    read = references(docs).join(named, "file").where("NOT a AND (field = 'keyterms_path' OR NOT b AND field LIKE 'entities.%')")
    found = read.join(lines, "path").select("file", F.when(F.col("field") == "keyterms_path", "keyterms_path").otherwise("lexicons").alias("source"), "term").distinct()
    return own.union(found)


def configs(docs: DataFrame) -> DataFrame:
    """(file, config_id, ..., usd_per_minute) of registries' configs."""
    c = docs.select("file", F.inline("d.configs"))
    return c.withColumn("usd_per_minute", F.when(F.col("pricing.unit") == "hour", F.col("pricing.amount") / 60).otherwise(F.col("pricing.amount")))
