"""The chain after the verdict, near duplicates included, against a row-by-row loop."""

import difflib

from pyspark.sql import functions as F

from quizloom.operators import quality as QP
from quizloom.operators import rules as Q
from quizloom.plans import registered
from quizloom.plans import verdicts as P
from quizloom.plans.items import items

STEMS = ["Which of these keys opens the window of the program", "What does the second law say about heat in closed rooms"]


def _small_bank(spark, sf_dir):
    """Rows of the bank with stems that are equal, near, or far, in and across sets."""
    ids = [r.id for r in items(spark, sf_dir).select("id").orderBy("id").limit(90).collect()]
    stems = []
    for n, i in enumerate(ids):
        base = STEMS[n % 2]
        texts = [base, base + "es", base.upper(), base[:-12] + "xyz"[n % 3] * 12, f"{"PQRST"[n // 5 % 5] * 30} {n} lonely words"]
        stems.append((i, n % 3, texts[n // 2 % 5] + "?"))
    new = spark.createDataFrame(stems, "id long, _set int, _stem string")
    bank = items(spark, sf_dir).join(F.broadcast(new), "id").withColumns(
        {
            "exam_set": F.col("_set"), "question": F.col("_stem"),
            "options": F.array(*map(F.lit, ("red one", "blue one", "green one", "black one"))),
            "correct_answer": F.when(F.col("id") % 13 == 0, "none").otherwise("blue one"),
            "question_type": F.when(F.col("id") % 4 == 0, F.col("question_type")).otherwise("standard"),
        }
    )
    return bank.drop("_set", "_stem").localCheckpoint()


def _loop(rows, classified, semantic):
    out, accepted = {}, []
    for r in sorted(rows, key=lambda r: r.id):
        key, why = r.question.strip().lower(), r.cheap
        if why is None:
            same = [s for s, k in accepted if k == key]
            near = [s for s, k in accepted if difflib.SequenceMatcher(None, key, k).ratio() >= 0.85]
            if same:
                why = "duplicate:" + ("within_set" if r.exam_set in same else "across_sets")
            elif near:
                why = "duplicate:" + ("near_in_set" if r.exam_set in near else "near_across_sets")
        if why is not None:
            out[r.id] = "rule_engine:" + why
        elif r.asks and r.id not in classified:
            out[r.id] = "difficulty_bloom:unclassified"
        elif r.scope is not None:
            out[r.id] = "course_alignment:" + r.scope
        elif r.id in semantic:
            out[r.id] = "semantic_duplicate:semantic"
        else:
            out[r.id] = None
            accepted.append((r.exam_set, key))
    return out


def test_registered_chain_equals_loop(spark, sf_dir, monkeypatch):
    bank = _small_bank(spark, sf_dir)
    semantic = {r.id for i, r in enumerate(bank.select("id").orderBy("id").collect()) if i % 11 == 5}
    classified = {r.id for r in P.classified(spark, sf_dir).collect()}
    monkeypatch.setattr(P, "vector_items", lambda *_: bank)
    monkeypatch.setattr(P.D, "semantic_duplicates", lambda *_: spark.createDataFrame([(i,) for i in sorted(semantic)], "id long"))
    rows = bank.select("id", "exam_set", "question", QP._cheap_reason().alias("cheap"), Q.needs_classifier().alias("asks"), Q.scope_reason().alias("scope")).collect()
    want = _loop(rows, classified, semantic)
    queries = registered.queries()
    assert {r.id: r.failed_stage for r in queries["stage_chain_with_fuzzy_tier"](spark, sf_dir).collect()} == want
    assert {"rule_engine:duplicate:near_in_set", "rule_engine:duplicate:near_across_sets"} <= set(want.values())
    uuid = {r.id: r.question_uuid for r in bank.select("id", "question_uuid").collect()}
    got = sorted((r.question_uuid, r.validator_failed, r.reason) for r in queries["stage_rejections_with_fuzzy_tier"](spark, sf_dir).collect())
    assert got == sorted((uuid[i], *v.split(":", 1)) for i, v in want.items() if v)


def test_rules_are_worked_out_once(spark, sf_dir):
    """The plan that is left reads the judged rows: no text is searched again, and only named columns are carried."""
    bank = _small_bank(spark, sf_dir)
    none = spark.createDataFrame([], "id long")
    chain = QP.after_verdict(bank, P.classified(spark, sf_dir), none, False, ["id"])
    assert chain.columns == ["id", "failed_stage", "attempts"]
    plan = chain._jdf.queryExecution().optimizedPlan().toString()
    assert "out_of_scope" not in plan and "no_end_mark" not in plan
    whole = QP.after_verdict(bank, P.classified(spark, sf_dir), none, False)
    assert whole.columns == [*bank.columns, "failed_stage", "attempts"]
    assert sorted(map(tuple, whole.select(chain.columns).collect()), key=str) == sorted(map(tuple, chain.collect()), key=str)
