"""Page assembly, contexts, prompts and answers against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tableprofile.operators import context, documents, enrich


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    rows = []
    for doc, numbers in {
        "hot": range(1, 60),
        "one": [1],
        "sparse": [3, 40, 41, 97],
        "late": [25, 26],
        "edge": range(0, 10),
        "blank": [1, 2],
    }.items():
        for n in numbers:
            text = "".join(rng.choice("añ b\n\t") for _ in range(rng.randrange(0, 40)))
            rows.append((doc, n, None if doc == "blank" else " " + text + " \n "))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id string, page_no int, text string").repartition(4)


def _whole(pages):
    texts = {}
    for r in sorted(pages.collect(), key=lambda r: (r["doc_id"], r["page_no"])):
        texts[r["doc_id"]] = texts.get(r["doc_id"], "") + f"\n--- PÁGINA {r['page_no']} ---\n{r['text'] or ''}\n"
    return {d: t.strip() for d, t in texts.items()}


@pytest.mark.parametrize("pages_per_part", [1, 4, 10, 1000])
def test_parts_make_up_the_document(pages, pages_per_part):
    parts = documents.assemble_pages(pages, pages_per_part=pages_per_part)
    joined = {}
    for r in sorted(parts.collect(), key=lambda r: (r["doc_id"], r["part_no"])):
        assert r["n_pages"] <= pages_per_part
        between = "\n" if r["doc_id"] in joined else ""
        assert not between or joined[r["doc_id"]].endswith("\n")
        joined[r["doc_id"]] = joined.get(r["doc_id"], "") + r["text"]
    assert joined == _whole(pages)


@pytest.mark.parametrize("pages_per_part", [1, 7, 1000])
@pytest.mark.parametrize("chars", [1, 20, 21, 300, 100_000])
def test_context_is_the_start_of_the_document(pages, pages_per_part, chars):
    parts = documents.assemble_pages(pages, pages_per_part=pages_per_part)
    got = {r["doc_id"]: (r["text"], r["truncated"]) for r in documents.document_context(parts, chars).collect()}
    assert got == {d: (t[:chars], len(t) > chars) for d, t in _whole(pages).items()}


@pytest.mark.parametrize("pages_per_part", [1, 7, 1000])
@pytest.mark.parametrize("chars", [1, 13, 300, 100_000])
def test_windows_make_up_the_document(pages, pages_per_part, chars):
    windows = documents.document_windows(documents.assemble_pages(pages, pages_per_part=pages_per_part), chars)
    joined = {}
    for r in sorted(windows.collect(), key=lambda r: (r["doc_id"], r["part_no"], r["window_no"])):
        assert len(r["text"]) <= chars
        joined[r["doc_id"]] = joined.get(r["doc_id"], "") + r["text"]
    assert joined == _whole(pages)


def test_a_question_is_asked_about_every_window(spark, pages):
    windows = documents.document_windows(documents.assemble_pages(pages, pages_per_part=4), 50)
    questions = spark.createDataFrame([("hot", "what?"), ("none", "who?")], "doc_id string, question string")
    prompts = context.document_prompt(questions, windows)
    assert prompts.where("doc_id = 'hot'").count() == windows.where("doc_id = 'hot'").count() > 20
    answers = enrich.answer_prompts(prompts, lambda: lambda p: p.split("[document]\n")[1].split("\n\n[question]")[0])
    got = {r["doc_id"]: r for r in enrich.gather_answers(answers).collect()}
    assert len(got["hot"]["answers"]) == windows.where("doc_id = 'hot'").count() and got["hot"]["failed"] == 0
    assert got["none"]["answers"] == [enrich.FAILED_ANSWER]


def test_context_of_exactly_the_limit_is_not_truncated(pages):
    whole = _whole(pages)["hot"]
    parts = documents.assemble_pages(pages.where("doc_id = 'hot'"), pages_per_part=3)
    assert not documents.document_context(parts, len(whole)).first()["truncated"]
    assert documents.document_context(parts, len(whole) - 1).first()["truncated"]


def test_fallback_sees_rejected_rows_only(spark):
    df = spark.createDataFrame([(1, "x" * 101), (2, "x" * 100), (3, None), (4, "")], "doc_id int, text string")
    result = documents.text_quality_gate(df, lambda weak: weak.withColumn("text", F.lit("scanned")))
    got = {r["doc_id"]: (r["method"], r["text"]) for r in result.collect()}
    assert got == {1: ("primary", "x" * 101), 2: ("fallback", "scanned"), 3: ("fallback", "scanned"), 4: ("fallback", "scanned")}


@pytest.fixture(scope="module")
def asked(spark):
    questions = spark.createDataFrame([("d1", "why?"), ("d1", "why?"), ("d2", "how?"), ("d3", "who?")], "doc_id string, question string")
    contexts = spark.createDataFrame([("d1", "text one", False), ("d2", "", False)], "doc_id string, text string, truncated boolean")
    return questions, contexts


def test_prompts_keep_every_question(spark, asked):
    questions, contexts = asked
    rows = context.document_prompt(questions, contexts).collect()
    assert len(rows) == 4
    prompts = {r["doc_id"]: r["prompt"] for r in rows}
    assert prompts["d3"] is None
    assert prompts["d1"] == f"{context.DOCUMENT_TASK}\n\n[document]\ntext one\n\n[question]\nwhy?"


def test_unified_prompt_has_a_header_only_with_its_context(spark, asked):
    questions, contexts = asked
    report = spark.createDataFrame([("42 rows",)], "text string")
    prompts = {r["doc_id"]: r["prompt"] for r in context.unified_prompt(questions, contexts, report).collect()}
    assert "[document]\ntext one" in prompts["d1"] and "[table statistics]\n42 rows" in prompts["d1"]
    assert "[document]" not in prompts["d2"] and "[document]" not in prompts["d3"]
    without = context.unified_prompt(questions, contexts, report.where("false")).first()["prompt"]
    assert "[table statistics]" not in without and "[question]" in without


def test_summary_prompt_names_what_is_missing(spark, asked):
    _, contexts = asked
    report = spark.createDataFrame([("42 rows",)], "text string")
    prompts = {r["doc_id"]: r["prompt"] for r in context.summary_prompt(contexts, report).collect()}
    assert "[document]\nNo disponible" in prompts["d2"]
    missing = {r["doc_id"]: r["prompt"] for r in context.summary_prompt(contexts, report.where("false")).collect()}
    assert missing["d1"].endswith("[table statistics]\nNo disponible")


def test_table_prompt(spark, asked):
    questions, _ = asked
    summary = spark.createDataFrame([("shape",)], "text string")
    assert context.table_prompt(questions, summary).count() == 4


def test_answers_collapse_repeats_and_survive_failures(spark, asked):
    questions, contexts = asked

    def client():
        def answer(prompt):
            if "text one" in prompt:
                raise RuntimeError("down")
            return "  " if "how" in prompt else "z" * 5000

        return answer

    rows = enrich.batch_answers(
        questions, lambda q: context.document_prompt(q, contexts), client, keys=("doc_id", "question")
    ).collect()
    got = {r["doc_id"]: (r["answer"], r["error"]) for r in rows}
    assert len(rows) == 3
    assert got["d1"] == (enrich.FAILED_ANSWER, "RuntimeError: down")
    assert got["d2"] == (enrich.EMPTY_ANSWER, None)
    assert got["d3"] == (enrich.FAILED_ANSWER, "no prompt")
    other = spark.createDataFrame([(1, "other")], "id int, prompt string")
    assert len(enrich.answer_prompts(other, client, tasks=3).first()["answer"]) == 5000


def test_a_failed_extraction_adds_no_text_and_goes_to_the_fallback(spark):
    rows = [("bad", None, None), ("good", 1, "t" * 200)]
    parts = documents.assemble_pages(spark.createDataFrame(rows, "doc_id string, page_no long, text string"))
    got = {r["doc_id"]: (r["n_pages"], r["chars"]) for r in parts.collect()}
    assert got["bad"] == (0, 0) and got["good"][0] == 1
    gate = documents.text_quality_gate(parts, lambda weak: weak.withColumn("text", F.lit("again")))
    assert {r["doc_id"]: r["method"] for r in gate.collect()} == {"bad": "fallback", "good": "primary"}
    contexts = {r["doc_id"]: (r["text"], r["truncated"]) for r in documents.document_context(gate, 4).collect()}
    assert contexts == {"bad": ("agai", True), "good": ("--- ", True)}
