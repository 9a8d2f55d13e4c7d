"""Ordered rule cascades (R0-R10) compiled to single Catalyst expressions.

A cascade is configuration: an ordered list of rules, each a label plus a condition.
``cascade`` folds it into one ``CASE WHEN`` so the first matching rule wins and the
whole thing runs inside whole-stage codegen.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import text as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def matches(c, pattern: str) -> Column:
    """Null-safe, case-insensitive, Unicode-aware ``search``."""
    return F.coalesce(_c(c).rlike(P.ci(P.grouped(pattern))), F.lit(False))


def count_matches(c, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(_c(c), F.lit(P.ci(pattern))), F.lit(0))


def count_words(c, pattern: str) -> Column:
    """``count_matches`` of a pattern whose alternatives are whole words: at most one of them
    matches at a place, so they may be tried in any order."""
    return count_matches(c, P.grouped(pattern))


# R0 ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Rule:
    """One row of a rule table.

    ``include``: patterns that must all match (conjunction); ``exclude``: patterns that
    must not match; ``pre_mask``: removed from the text before ``include`` is tested.
    """
    label: str
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    pre_mask: str | None = None
    column: str | None = None      # match another input column instead of the default

    def condition(self, text: Column, columns: dict[str, Column] | None = None) -> Column:
        src = (columns or {}).get(self.column, text) if self.column else text
        masked = F.regexp_replace(src, P.ci(self.pre_mask), " ") if self.pre_mask else src
        cond = F.lit(True)
        for p in self.include:
            cond = cond & matches(masked, p)
        for p in self.exclude:
            cond = cond & ~matches(src, p)
        return cond


@dataclass(frozen=True)
class RuleTable:
    rules: Sequence[Rule]
    default: str | None = None
    name: str = "rules"
    meta: dict = field(default_factory=dict)

    def compile(self, text, columns: dict[str, Column] | None = None) -> Column:
        return cascade([(r.label, r.condition(_c(text), columns)) for r in self.rules],
                       self.default)

    def fired(self, text, columns: dict[str, Column] | None = None) -> Column:
        """All labels whose rule matches (multi-label), in table order."""
        return F.filter(F.array(*[F.when(r.condition(_c(text), columns), F.lit(r.label))
                                  for r in self.rules]), lambda x: x.isNotNull())

    def version(self) -> str:
        """Content hash; stored with outputs so a result names the rules that made it."""
        body = json.dumps([[r.label, list(r.include), list(r.exclude), r.pre_mask, r.column]
                           for r in self.rules] + [self.default], sort_keys=True)
        return hashlib.sha256(body.encode()).hexdigest()[:16]


def cascade(branches: Iterable[tuple[str | Column, Column]], default=None) -> Column:
    """First true condition wins; ``default`` otherwise (a literal or a Column)."""
    expr = None
    for label, cond in branches:
        val = label if isinstance(label, Column) else F.lit(label)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    dflt = default if isinstance(default, Column) else F.lit(default)
    return dflt if expr is None else expr.otherwise(dflt)


# R1 ---------------------------------------------------------------------------
def resolution_type(reply) -> Column:
    """Six-way label for how a reply closed the thread; order is semantics."""
    reply = _c(reply)
    txt = T.strip_dm_links(reply)
    says_dm = matches(txt, P.DM)
    instruct = matches(txt, P.INSTRUCT)
    return cascade([
        ("other_channel_redirect", matches(txt, P.REDIRECT)),
        (F.when(says_dm, F.lit("answer_with_dm_followup")).otherwise(F.lit("self_contained_answer")),
         T.has_foreign_link(reply)),
        ("dm_handoff", says_dm | (txt != reply)),
        ("clarifying_question", F.contains(txt, F.lit("?")) & ~instruct),
        ("self_contained_answer", instruct | (T.residual_word_count(txt) >= 8)),
    ], "other")


# R2 ---------------------------------------------------------------------------
def foreign_hits(c) -> Column:
    return count_words(c, P.FOREIGN)


def is_non_english(customer, brand=None) -> Column:
    """Positive evidence: the brand's language redirect, two foreign function words, one
    with no English stop word, or an accented letter with no English stop word.

    The foreign-word count is evaluated once: the outcome for 0, 1 and 2+ hits is
    picked from an array indexed by ``least(hits, 2)``."""
    customer = _c(customer)
    hits = foreign_hits(customer)
    no_stop = ~matches(customer, P.ENGLISH_STOP)
    redirect = matches(brand, P.LANG_REDIRECT) if brand is not None else F.lit(False)
    by_hits = F.array(matches(customer, P.ACCENTED) & no_stop, no_stop, F.lit(True))
    return redirect | F.element_at(by_hits, F.least(hits, F.lit(2)) + 1)


# R3 ---------------------------------------------------------------------------
FIRST_PASS = RuleTable(name="first_pass_intent", rules=[
    Rule("ios_version_downgrade", include=[P.DOWNGRADE]),
    Rule("battery_drain", include=[P.BATTERY]),
    Rule("billing_account", include=[P.BILLING], pre_mask=P.APPLE_PAY),
    # both must match; the cheaper scan goes first (a conjunction is order-free)
    Rule("software_feature_defect", include=[P.SYMPTOM, P.COMPONENT]),
], default=P.RESIDUAL)


def label_intent(customer, brand=None) -> Column:
    """Language first, then the most specific topic signal; vague complaint is the
    fallback."""
    customer = _c(customer)
    return F.when(is_non_english(customer, brand), F.lit("non_english")) \
        .otherwise(FIRST_PASS.compile(customer))


# R4 / R9 -------------------------------------------------------------------------
def downgrade_evidence(c) -> Column:
    return matches(c, P.DOWNGRADE_EVIDENCE)


def looks_non_english(c) -> Column:
    """Non-Latin script decides; an explicit downgrade phrase is English evidence;
    otherwise four or more words with no English function word."""
    c = _c(c)
    fw = F.array(*[F.lit(w) for w in P.ENGLISH_FW])
    toks = T.word_tokens(c)
    return F.when(F.coalesce(c.rlike(P.NON_LATIN), F.lit(False)), F.lit(True)) \
        .when(downgrade_evidence(c), F.lit(False)) \
        .otherwise((F.size(toks) >= P.FW_MIN_WORDS) & ~F.arrays_overlap(toks, fw))


# R5 ---------------------------------------------------------------------------
def resolve(text, model_label) -> Column:
    """Final label from a raw model label and the text: non-English by rule, evidenced
    downgrade, thin to residual, model ``non_english`` to out of scope, else pass."""
    text, lab = _c(text), _c(model_label)
    return cascade([
        ("non_english", looks_non_english(text)),
        (F.when(downgrade_evidence(text), lab).otherwise(F.lit(P.RESIDUAL)),
         lab == F.lit("ios_version_downgrade")),
        (P.RESIDUAL, T.is_thin(text)),
        (P.OUT_OF_SCOPE, lab == F.lit("non_english")),
    ], lab)


# R6 / R7 -------------------------------------------------------------------------
OOS = RuleTable(name="out_of_scope_kind",
                rules=[Rule(k, include=[p]) for k, p in P.OOS_KINDS], default=None)


def oos_kind(c) -> Column:
    return OOS.compile(c)


def blind_spot(c) -> Column:
    c = _c(c)
    return matches(c, P.BLIND) & ~T.is_thin(c) & oos_kind(c).isNull()


# R8 ---------------------------------------------------------------------------
OVERRIDE_TABLE = RuleTable(name="overrides",
                           rules=[Rule(k, include=[p]) for k, p in P.OVERRIDES])


def check_overrides(text, intent=None) -> Column:
    """All fired override labels in table order; an intent with a policy label adds it
    and then the list is sorted and distinct."""
    fired = OVERRIDE_TABLE.fired(_c(text))
    if intent is None:
        return fired
    pol = F.create_map(*[x for k, v in P.POLICY_ESCALATE_INTENTS.items()
                         for x in (F.lit(k), F.lit(v))])[_c(intent)]
    return F.when(pol.isNull(), fired).otherwise(
        F.array_sort(F.array_union(fired, F.array(pol))))


# R10 --------------------------------------------------------------------------
def gap_fill(model_label, rule_label, residual: str = P.RESIDUAL) -> Column:
    return F.coalesce(_c(model_label), _c(rule_label), F.lit(residual))
