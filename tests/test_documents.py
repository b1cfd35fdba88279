"""Profiles and registries: each rule by a document that breaks it, files that are named, and refusals inside plans."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from vocalith.operators import refusals
from vocalith.sources import documents as D

PROFILE = {"use_case": {"name": "n", "domain": "d", "channel": "telephony_8k", "languages": ["en-US", "de"], "avg_call_minutes": 3, "agent_talk_ratio": 0.5}}
BAD_FIELDS = [
    ("use_case.channel", "pstn", "channel"), ("use_case.languages", [], "use_case_incomplete"), ("use_case.languages", ["English"], "language"), ("use_case.agent_talk_ratio", 1.5, "not_a_rate"), ("use_case.avg_call_minutes", 0, "not_positive"),
    ("use_case.name", "", "use_case_incomplete"), ("constraints.stack.min_task_success_rate", -0.1, "not_a_rate"), ("constraints.stack.max_p95_ttfa_ms", 0, "not_positive"), ("constraints.stack.deployment", "cloud", "deployment"), ("constraints.stack.min_concurrency", 0, "not_positive"),
    ("constraints.turn_taking.max_premature_endpoint_rate", 2, "not_a_rate"), ("constraints.llm.min_check_pass_rate", {"x": 1.1}, "not_a_rate"), ("constraints.tts.max_roundtrip_wer", 1.01, "not_a_rate"), ("constraints.stt.unknown", 1, "unknown_field"), ("surprise.deep", 1, "unknown_field"),
    ("constraints.stt.min_entity_recall", {"ghost": 0.9}, "recall_of_unknown_entity"), ("use_case.avg_call_minutes", "long", "wrong_type"), ("use_case.languages", "en", "wrong_type"), ("audio.manifest_path", "", "empty_manifest"), ("keyterms_path", "absent.txt", "missing_file keyterms_path"),
    ("conversation_scripts", "scripts.jsonl", "missing_file conversation_scripts"), ("audio.manifest_path", "customer.jsonl", "missing_file audio.manifest_path"),
]
BAD_ENTITIES = [
    ([{"name": "Drug", "kind": "builtin", "builtin": "number"}], "entity_name"), ([{"name": "x", "kind": "regex"}], "entity_without_source"), ([{"name": "x", "kind": "regex", "pattern": "(unclosed"}], "entity_pattern"), ([{"name": "x", "kind": "builtin", "builtin": "zipcode"}], "entity_builtin"),
    ([{"name": "x", "kind": "builtin", "builtin": "date", "pattern": "x"}], "entity_with_other_source"), ([{"name": "x", "kind": "lexicon", "lexicon_path": "missing.txt"}], "missing_file entities.x.lexicon_path"), ([{"name": "x", "kind": "builtin", "builtin": "date"}] * 2, "duplicate_entities"), ([{"name": "x", "kind": "guess", "pattern": "x"}], "entity_kind"),
]


def _with(doc, dotted, value):
    doc = at = copy.deepcopy(doc)
    *path, last = dotted.split(".")
    for p in path:
        at = at.setdefault(p, {})
    at[last] = value
    return doc


def test_each_rule_of_a_profile(session, tmp_path):
    want = {}
    for i, (doc, rule) in enumerate([(_with(PROFILE, f, v), r) for f, v, r in BAD_FIELDS] + [(PROFILE | {"entities": e}, r) for e, r in BAD_ENTITIES] + [(PROFILE | {"keyterms": ["a"], "keyterms_path": "here.txt"}, "two_key_term_lists")]):
        (tmp_path / f"{i:02d}.yaml").write_text(json.dumps(doc))
        want[f"{i:02d}.yaml"] = {rule}
    (tmp_path / "here.txt").write_text("a\n")
    (tmp_path / "x-good.yaml").write_text(json.dumps(PROFILE | {"entities": [{"name": "drug", "kind": "lexicon", "lexicon_path": "./here.txt"}], "constraints": {"stt": {"min_entity_recall": {"drug": 1}}, "llm": {"min_check_pass_rate": {"any": 0}}}}))
    (tmp_path / "y-broken.yaml").write_text("use_case: [unclosed")
    (tmp_path / "z-list.yml").write_text("- a\n- b\n")
    want |= {"y-broken.yaml": {"unreadable"}, "z-list.yml": {"unreadable"}}
    got = {}
    for r in D.profile_violations(session, str(tmp_path)).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], set()).add(r.rule)
    assert got == want


ENTRY = {"config_id": "c", "provider": "p", "model_id": "m", "mode": "batch", "env_key": "KEY_1", "settings": {"free": {"deep": 1}, "n": 2}, "pricing": {"amount": 0.6, "unit": "hour", "billing_basis": "audio_duration", "source": "s", "as_of": "2025-01-02"}}
BAD_ENTRIES = [
    ([ENTRY, ENTRY], "duplicate_configs"), ([_with(ENTRY, "pricing.billing_basis", "per_word")], "pricing"), ([_with(ENTRY, "pricing.source", None)], "pricing"), ([_with(ENTRY, "pricing.as_of", None)], "pricing"), ([_with(_with(ENTRY, "pricing.amount", None), "verify", False)], "verified_without_price"),
    ([_with(ENTRY, "pricing.amount", 0)], "price"), ([_with(ENTRY, "mode", "realtime")], "mode"), ([_with(ENTRY, "config_id", "Bad-Id")], "config_id"), ([_with(ENTRY, "env_key", "lowercase")], "env_key"), ([_with(ENTRY, "baa", {"status": "yes"})], "baa_without_source"), ([_with(ENTRY, "baa", {"status": "maybe", "source": "s"})], "baa"),
    ([_with(ENTRY, "surprise", 1)], "unknown_field"), ([_with(ENTRY, "base_url", "http://insecure.example.com")], "base_url"), ([_with(ENTRY, "output_date_order", "ymd")], "date_order"), ([_with(ENTRY, "provider", None)], "provider"), ([_with(ENTRY, "model_id", "")], "model_id"), ("none", "wrong_type"), (None, "no_configs"),
]


def test_each_rule_of_a_registry(session, tmp_path):
    for i, (entries, _) in enumerate(BAD_ENTRIES):
        (tmp_path / f"{i:02d}.yaml").write_text(json.dumps({"configs": entries}))
    good = [_with(ENTRY, "base_url", "https://host.example/v1"), _with(_with(ENTRY, "config_id", "d"), "pricing.unit", "minute")]
    (tmp_path / "good.yaml").write_text(json.dumps({"configs": good}))
    got = {}
    for r in D.registry_violations(session, str(tmp_path)).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], set()).add(r.rule)
    assert got == {f"{i:02d}.yaml": {rule} for i, (_, rule) in enumerate(BAD_ENTRIES)}
    c = {r.config_id: r for r in D.configs(D.read_documents(session, str(tmp_path / "good.yaml"), D.REGISTRY_DOC)).collect()}
    assert c["c"].usd_per_minute == pytest.approx(0.01) and c["d"].usd_per_minute == 0.6 and json.loads(c["c"].settings["free"]) == {"deep": 1}


def test_key_terms_by_precedence(session, tmp_path):
    lexicon = [{"name": "drug", "kind": "lexicon", "lexicon_path": "drugs.txt"}, {"name": "place", "kind": "lexicon", "lexicon_path": "sub/places.txt"}, {"name": "n", "kind": "builtin", "builtin": "number"}]
    (tmp_path / "sub").mkdir()
    (tmp_path / "drugs.txt").write_text("# a comment\nAspirin\n\n beta blocker \n")
    (tmp_path / "sub" / "places.txt").write_text("Ward\nAspirin\n")
    (tmp_path / "list.txt").write_text("Listed\n")
    docs = {"own": {"keyterms": ["Mine"]}, "listed": {"keyterms_path": "list.txt"}, "lexicons": {}}
    for name, more in docs.items():
        (tmp_path / f"{name}.yaml").write_text(json.dumps(PROFILE | {"entities": lexicon} | more))
    got = {}
    for r in D.boost_terms(session, str(tmp_path)).collect():
        got.setdefault((r.file.rsplit("/", 1)[1], r.source), []).append(r.term)
    assert {k: sorted(v) for k, v in got.items()} == {("own.yaml", "keyterms"): ["Mine"], ("listed.yaml", "keyterms_path"): ["listed"], ("lexicons.yaml", "lexicons"): ["aspirin", "beta blocker", "ward"]}
    assert D.profile_violations(session, str(tmp_path)).count() == 0


def test_plans_refuse_what_has_no_answer(session):
    s = session.createDataFrame([("c1", "u1", 2, 1), ("c1", "u2", 0, 3), ("c2", "u1", 0, 1)], "config_id STRING, utt_id STRING, n_ref BIGINT, errors BIGINT")
    assert [tuple(r) for r in refusals.pooled(s.where("config_id = 'c1'"), ["config_id"]).collect()] == [("c1", 4, 2, 2.0, 0.5)]
    with pytest.raises(Exception, match="no reference words: c2"):
        refusals.pooled(s, ["config_id"]).collect()
    with pytest.raises(Exception, match="no reference words"):
        refusals.pooled(s.limit(0)).collect()
    clusters = session.createDataFrame([("u1", "a")], "utt_id STRING, cluster STRING")
    assert refusals.with_clusters(s.where("utt_id = 'u1'"), clusters).count() == 2
    with pytest.raises(Exception, match="no cluster for u2"):
        refusals.with_clusters(s, clusters).collect()
    with pytest.raises(Exception, match="several clusters for u1"):
        refusals.with_clusters(s, clusters.union(clusters.selectExpr("utt_id", "'b'"))).collect()
    runs = lambda *rows: session.createDataFrame(rows, "config_id STRING, settings STRING, model_id STRING")
    clean = runs(("c1", '{"a": 1}', "m"), ("c2", "{}", "m"))
    assert refusals.paired_configs(clean, runs(("c1", '{"a": 1}', "m"), ("c3", "{}", "m"))).collect() == [("c1",)]
    with pytest.raises(Exception, match="c2 differs in model_id, settings"):
        refusals.paired_configs(clean, runs(("c2", '{"b": 1}', "other"))).collect()
