"""Queries over probe messages: every class and branch must occur, or the oracle proves nothing."""
import pytest
from conftest import SF01

from parley.functions import patterns as P
from parley.plans.registry import QUERIES

WANT = {
    "r3_probe_intents": ("intent", {"software_feature_defect", "ios_version_downgrade", "battery_drain", "billing_account", P.RESIDUAL, "non_english"}),
    "r1_probe_resolution": ("rtype", {"other_channel_redirect", "answer_with_dm_followup", "self_contained_answer", "dm_handoff", "clarifying_question", "other"}),
    "r5_probe_resolve": ("label", {"ios_version_downgrade", "battery_drain", "billing_account", "software_feature_defect", P.RESIDUAL, "non_english", P.OUT_OF_SCOPE}),
    "r6_r7_probe_scope": ("kind", {k for k, _ in P.OOS_KINDS} | {None}),
    "f8_probe_provenance": ("provenance", {"circular", "independent"}),
    "a10_probe_override_counts": ("item", {k for k, _ in P.OVERRIDES}),
    "g9_f9_probe_decisions": ("route", {"escalate_override", "no_draft_policy", "policy_fact", "no_usable_grounding"}),
}


@pytest.mark.parametrize("name", sorted(WANT))
def test_every_class_occurs(spark, name):
    col, want = WANT[name]
    assert {r[0] for r in QUERIES[name](spark, SF01).select(col).distinct().collect()} >= want


def test_branches_occur(spark):
    q = lambda n: QUERIES[n](spark, SF01)
    assert q("r6_r7_probe_scope").filter("blind").count() > 0
    assert q("r8_u3_probe_overrides").filter("labels like '%,%'").count() > 0
    found = {x.split(":")[0] for r in q("x13_u4_probe_unsupported").collect() for x in r.findings.split("|") if x}
    assert found == {"path", "version", "feature"}
    flags = {x.split(":")[0] for r in q("x9_x10_probe_flags").collect() for x in r.flags.split(",") if x}
    assert flags == {"over_length", "narration"} and q("x9_x10_probe_flags").filter("bug").count() > 0
    assert q("e9_probe_conformance").filter("circular").count() > 0 and q("e9_probe_disagreements").count() > 0
    assert q("g9_f9_probe_decisions").filter("has_final_draft").count() > 0
    assert q("r9_script_evidence").select("non_english").distinct().count() == 2
