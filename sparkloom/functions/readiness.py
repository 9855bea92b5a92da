"""Readiness, confidence and set-up decisions as column expressions, so that any number of slots, packs or tasks is decided in one pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score floors and margins of the confidence of a task's result.
EMPTY_FLOOR, ANCHORED_FLOOR, UNANCHORED_FLOOR = 0.05, 0.5, 0.95
MARGIN_SECOND, MARGIN_THIRD = 0.12, 0.15
# Bounds of the set-up bands (low below the first, partial below the second).
BANDS = {"corpus": (0.30, 0.70), "scope": (0.50, 0.80), "probes": (0.50, 0.80)}
LEAST_CHUNKS, USEFUL_CHUNKS, PARTIAL_CARDS = 5, 50, 5
# What to do about a slot.
ACTIONS = {"ready": "answer", "blocked": "ask_user", "retry_required": "retry_slot", "partial": "answer_with_caveat"}


def cases(*pairs: tuple[Column, str], default: str) -> Column:
    """Value of the first condition that holds."""
    out = F.lit(default)
    for condition, value in reversed(pairs):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def adequate_search(n_expected: Column, n_searched: Column, scope_found: Column, scope_total: Column) -> Column:
    by_type = cases((n_searched == n_expected, "adequate"), (n_searched > 0, "partial"), default="insufficient")
    by_scope = cases((scope_total == 0, "not_applicable"), (scope_found >= scope_total, "adequate"), (scope_found > 0, "partial"), default="insufficient")
    return F.when(n_expected > 0, by_type).otherwise(by_scope)


def slot_readiness(slots):
    """slots with adequate, confidence, readiness, action, finding and reasons (joined by commas).

    Columns needed: required, task_critical (null: as required), is_missing_check, sections, evidence_total, evidence_found, scope_total,
    scope_found, expected, available (null: anything), searched (arrays of source types).
    """
    c = F.col
    none = F.array().cast("array<string>")
    expected = F.coalesce(c("expected"), none)
    out = slots.withColumns({
        "n_expected": F.size(expected),
        "n_absent": F.when(c("available").isNull(), 0).otherwise(F.size(F.filter(expected, lambda x: ~F.array_contains(c("available"), x)))),
        "n_searched": F.size(F.filter(expected, lambda x: F.array_contains(F.coalesce(c("searched"), none), x))),
        "critical": F.coalesce(c("task_critical"), c("required")),
        "has_evidence": c("evidence_found") >= c("evidence_total"),
        "has_scope": c("scope_found") >= c("scope_total"),
    })
    out = out.withColumn("adequate", adequate_search(c("n_expected"), c("n_searched"), c("scope_found"), c("scope_total")))
    by_type = (c("n_expected") > 0) & (c("adequate") == "adequate")
    types_done = (c("n_expected") == 0) | by_type
    absence_only = c("is_missing_check") & (c("evidence_total") == 0)
    out = out.withColumn("could_find", c("is_missing_check") & types_done & (((c("scope_total") > 0) & c("has_scope")) | by_type))
    out = out.withColumn("complete", c("has_evidence") & types_done & F.when(absence_only, c("could_find")).otherwise(c("has_scope")))
    out = out.withColumn("confidence", cases(
        (c("sections") == 0, "empty"), (c("complete"), "confident"), ((c("evidence_found") > 0) | (c("scope_found") > 0), "uncertain"), default="weak",
    ))
    out = out.withColumn("readiness", cases(
        (c("complete"), "ready"), (c("required") & (c("n_absent") > 0), "blocked"), (c("required") & c("critical"), "retry_required"), default="partial",
    ))
    reasons = [
        (c("sections") == 0, "retrieval_empty"), (c("confidence") == "weak", "retrieval_weak"), (~c("has_evidence"), "required_evidence_missing"),
        (c("n_absent") > 0, "required_source_type_unavailable"), (~c("has_scope"), "searched_scope_incomplete"),
        ((c("n_expected") > 0) & ~by_type, "source_type_search_incomplete"), (c("could_find") & (c("scope_total") > 0), "missing_context_supported_by_searched_scope"),
        (c("could_find") & by_type, "missing_context_supported_by_source_type_search"), (absence_only & ~c("could_find"), "missing_context_search_unverified"),
        (c("complete"), "all_required_support_found"),
    ]
    said = F.concat_ws(",", *[F.when(when, F.lit(name)) for when, name in reasons])
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[c("readiness")]
    return out.withColumns({"action": action, "finding": c("could_find") & c("complete"), "reasons": F.when(said == "", "optional_slot_incomplete").otherwise(said)})


def pack_readiness(slots, pack: str, slot: str):
    """(pack, readiness, blocking, retry, partial, findings) over the result of slot_readiness; lists of slots are sorted and joined by commas."""
    c = F.col
    gated = c("required") & c("critical")
    kinds = {
        "blocking": gated & (c("readiness") == "blocked"), "retry": gated & c("readiness").isin("retry_required", "partial"),
        "partial": c("readiness") == "partial", "findings": c("finding"),
    }
    out = slots.groupBy(pack).agg(*[F.array_join(F.array_sort(F.collect_list(F.when(k, c(slot).cast("string")))), ",").alias(n) for n, k in kinds.items()])
    return out.withColumn("readiness", cases((c("blocking") != "", "blocked"), (c("retry") != "", "retry_required"), (c("partial") != "", "partial"), default="ready"))


def result_confidence(n: Column, top: Column, second: Column, third: Column, anchored: Column, signal_empty: Column, locked=None, verdict=None, weak=None) -> Column:
    """confident, uncertain or empty. weak: the result carries a warning of low confidence; verdict: of the coverage check, if any."""
    no = F.lit(False)
    close = ((n >= 2) & (top - second < MARGIN_SECOND)) | ((n >= 3) & (top - third < MARGIN_THIRD))
    poor = no if verdict is None else F.coalesce(verdict.isin("unsupported", "partial", "needs_anchors"), no)
    weak = no if weak is None else weak
    return cases(
        (no if locked is None else locked, "confident"), (n == 0, "empty"), (poor, "uncertain"), (signal_empty & (top < EMPTY_FLOOR), "empty"), (signal_empty, "uncertain"),
        (~anchored & close, "uncertain"), (weak & (top < EMPTY_FLOOR), "empty"), (weak, "uncertain"),
        (top >= F.when(anchored, ANCHORED_FLOOR).otherwise(UNANCHORED_FLOOR), "confident"), (top < EMPTY_FLOOR, "empty"), default="uncertain",
    )


def band(part: Column, whole: Column, kind: str) -> Column:
    low, partial = BANDS[kind]
    rate = F.try_divide(part.cast("double"), whole.cast("double"))
    return cases(((whole == 0) | (rate < low), "low"), (rate < partial, "partial"), default="confident")


def corpus_band(imported: Column, discoverable: Column, chunks: Column) -> Column:
    return F.when(chunks < LEAST_CHUNKS, "low").otherwise(band(imported, discoverable, "corpus"))


def card_band(accepted: Column, constraints: Column) -> Column:
    return cases((accepted == 0, "low"), ((accepted <= PARTIAL_CARDS) | (constraints < 1), "partial"), default="confident")


def next_step(pending: Column, corpus: Column, scope: Column, cards: Column, probes: Column, chunks: Column) -> Column:
    return cases(
        (pending, "review_inbox"),
        ((corpus == "confident") & (scope == "confident") & (cards == "confident") & (probes == "confident"), "all_confident"),
        ((cards == "low") & (chunks >= USEFUL_CHUNKS) & (scope != "low"), "bootstrap_despite_low_corpus"), (corpus == "low", "import_more_docs"),
        (cards == "low", "bootstrap_cards"), (scope == "low", "fix_scope_layer"), (probes == "low", "tune_retrieval"), default="validate_with_context",
    )
