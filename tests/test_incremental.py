"""Jobs that go on where they were: extraction by listing, answers by ledger, assembly in bounded parts."""

import os

import pytest
from pyspark.sql import functions as F

from tableprofile.operators import documents, enrich
from tableprofile.plans import ingest
from tableprofile.sources import pages


def extractor(calls, fail=""):
    def extract(content: bytes):
        with open(calls, "a") as log:
            log.write(content.decode() + "\n")
        if fail and fail in content.decode():
            raise ValueError(fail)
        return [(i, t) for i, t in enumerate(content.decode().split("|"), 1) if t]

    return extract


def run(spark, folder, cache, calls, **more):
    before = len(calls.read_text().splitlines()) if calls.exists() else 0
    found = pages.extract_new_files(pages.list_files(spark, str(folder)), cache, extractor(str(calls), more.pop("fail", "")), **more).collect()
    read = calls.read_text().splitlines()[before:] if calls.exists() else []
    return sorted((r["stem"], r["page_no"], r["text"]) for r in found), sorted(read)


def test_listing_reads_no_content_and_only_new_files_are_read(spark, tmp_path):
    folder, cache, calls = tmp_path / "files", str(tmp_path / "cache"), tmp_path / "calls"
    folder.mkdir()
    plan = pages.list_files(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    assert run(spark, folder, cache, calls) == ([], [])
    for name, text in (("a b", "1|2"), ("c[1]{x}", "3"), ("d*%20", "||"), ("bad", "bad|4")):
        (folder / f"{name}.txt").write_text(text)
    want = [("a b", 1, "1"), ("a b", 2, "2"), ("c[1]{x}", 1, "3")]
    assert run(spark, folder, cache, calls, fail="bad", files_per_run=2) == (want, ["1|2", "3", "bad|4", "||"])
    # Other bytes of the same time and length would be seen if anything were read again.
    stat = os.stat(folder / "a b.txt")
    (folder / "a b.txt").write_text("9|9")
    os.utime(folder / "a b.txt", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    want = [*want[:2], ("bad", 1, "bad"), ("bad", 2, "4"), want[2]]
    assert run(spark, folder, cache, calls) == (want, ["bad|4"])
    (folder / "c[1]{x}.txt").write_text("changed")
    assert run(spark, folder, cache, calls) == ([*want[:4], ("c[1]{x}", 1, "changed")], ["changed"])
    (folder / "bad.txt").unlink()
    assert run(spark, folder, cache, calls) == ([*want[:2], ("c[1]{x}", 1, "changed")], [])


def test_a_broken_run_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    folder, cache, calls = tmp_path / "files", str(tmp_path / "cache"), tmp_path / "calls"
    folder.mkdir()
    for i in range(6):
        (folder / f"{i}.txt").write_text(str(i))
    whole, seen = pages._extract_run, []

    def breaks(*args):
        seen.append(args)
        if len(seen) == 2:
            raise RuntimeError("lost")
        whole(*args)

    monkeypatch.setattr(pages, "_extract_run", breaks)
    with pytest.raises(RuntimeError):
        run(spark, folder, cache, calls, files_per_run=2)
    found, read = run(spark, folder, cache, calls, files_per_run=2)
    assert [t for *_, t in found] == list("012345") and len(read) == 4
    assert sorted(calls.read_text().split()) == list("012345")


def test_listed_documents_take_the_fallback_where_needed(spark, tmp_path):
    for name, text in (("long", "t" * 200), ("short", "t"), ("none", "|")):
        (tmp_path / f"{name}.txt").write_text(text)
    calls = [tmp_path / "primary", tmp_path / "fallback"]

    def again():
        log = str(calls[1])

        def extract(content: bytes):
            with open(log, "a") as f:
                f.write("x")
            return [(1, "again")]

        return extract

    for _ in range(2):
        listed = pages.list_files(spark, str(tmp_path), "*.txt")
        got = pages.extract_new_documents(listed, str(tmp_path / "cache"), extractor(str(calls[0])), again()).collect()
        assert {r["path"].split("/")[-1]: (r["method"], r["text"][-5:]) for r in got} == {
            "long.txt": ("primary", "ttttt"), "short.txt": ("fallback", "again"), "none.txt": ("fallback", "again")
        }
    assert len(calls[0].read_text().splitlines()) == 3 and calls[1].read_text() == "xx"


def client(log, breaks_on=None):
    def make():
        def answer(prompt: str) -> str:
            with open(log, "a") as f:
                f.write(prompt + "\n")
            if prompt == breaks_on:
                os._exit(1)
            if prompt.startswith("bad"):
                raise ValueError("bad")
            return prompt.upper()

        return answer

    return make


def test_answered_prompts_are_never_asked_again(spark, tmp_path):
    ledger, log = str(tmp_path / "ledger"), tmp_path / "log"
    prompts = [f"p{i}" for i in range(40)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate([*prompts, *prompts])], "id long, prompt string").repartition(2)
    with pytest.raises(Exception):
        enrich.ledger_answers(df, client(str(log), "p7"), ledger, prompts_per_run=4)
    written = {r.answer.lower() for r in enrich._ledger(spark, ledger).collect()}
    before = log.read_text().split()
    got = enrich.ledger_answers(df, client(str(log)), ledger, prompts_per_run=4).collect()
    assert {r.id: r.answer for r in got} == {i: p.upper() for i, p in enumerate([*prompts, *prompts])}
    after = log.read_text().split()[len(before):]
    assert 0 < len(written) < 40 and not written & set(after)
    assert len(after) == len(set(after)) == 40 - len(written)  # equal prompts cost one call


def test_failed_and_null_prompts(spark, tmp_path):
    ledger, log = str(tmp_path / "ledger"), tmp_path / "log"
    df = spark.createDataFrame([(1, "x"), (2, "bad"), (3, None)], "id long, prompt string")
    for _ in range(2):
        got = {r.id: (r.answer, r.error) for r in enrich.ledger_answers(df, client(str(log)), ledger).collect()}
        assert got == {1: ("X", None), 2: (enrich.FAILED_ANSWER, "ValueError: bad"), 3: (enrich.FAILED_ANSWER, "no prompt")}
    assert sorted(log.read_text().split()) == ["bad", "bad", "x"]
    assert enrich.ledger_answers(df.limit(0), client(str(log)), str(tmp_path / "none")).count() == 0


def whole(df):
    return {k: "".join(t for _, t in sorted(v)) for k, v in df.rdd.map(lambda r: (r.doc_id, (r.part_no, r.text))).groupByKey().collect()}


def test_parts_are_bounded_and_are_the_document(spark):
    n = F.col("id")
    long_doc = spark.range(3000).select(F.lit(1).alias("doc_id"), n.alias("page_no"), F.concat(F.lit("page "), n.cast("string"), F.repeat(F.lit("\n"), (n % 3).cast("int"))).alias("text"))
    odd = spark.createDataFrame(
        [(2, 1, "é" * 5000), (2, 2, None), (3, 1, "x \n\n"), (4, None, "lost"), (5, 7, "a" * 73), (5, 1007, "  \n"), (6, None, None), (6, 1, "y")],
        "doc_id int, page_no long, text string",
    )
    pages_ = long_doc.unionByName(odd)
    parts = documents.assemble_parts(pages_, part_chars=100, pages_per_slice=200).cache()
    assert parts.agg(F.max(F.length("text")), F.max("chars")).first() == (100, 100)
    assert parts.groupBy("doc_id").agg((F.max("part_no") + 1 == F.count("*")).alias("ok")).where("NOT ok").isEmpty()
    assert whole(parts) == whole(documents.assemble_pages(pages_))
    counts = {r.doc_id: r.n for r in parts.groupBy("doc_id").agg(F.sum("n_pages").alias("n")).collect()}
    assert counts == {1: 3000, 2: 2, 3: 1, 4: 0, 5: 2, 6: 1}
    assert documents.assemble_parts(pages_.limit(0)).count() == 0
    plan = documents.assemble_parts(pages_)._jdf.queryExecution().executedPlan().toString()
    texts = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_slice" in line]
    assert len(texts) == 3  # lengths, the starts of pages, and texts, each once


def test_pages_are_handed_on_while_a_file_is_read(spark, tmp_path, monkeypatch):
    content = b"".join(b"%d \xc3\xa9\n" % i for i in range(1000)) + b"\r\n\nlast"
    found = ingest.lines_of_file()(content)
    assert iter(found) is found  # no list of all lines
    assert list(found) == list(enumerate(content.decode().split("\n")[:-1], 1))
    monkeypatch.setattr(pages, "CHARS_PER_BATCH", 40)
    handed = str(tmp_path / "handed")

    def long_pages(content: bytes):
        for i in range(content[0]):
            with open(handed, "a") as log:
                log.write("x")
            yield i, "y" * 30
        raise ValueError("end")

    files = spark.createDataFrame([("a", bytearray([5])), ("b", None), ("c", bytearray([1]))], "stem string, content binary").coalesce(1)
    rows = pages.extract_pages(files, long_pages).collect()
    want = [("a", i, "y" * 30, None) for i in range(5)] + [("a", None, None, "ValueError: end")]
    want += [("b", None, None, "TypeError: cannot convert 'NoneType' object to bytes"), ("c", 0, "y" * 30, None), ("c", None, None, "ValueError: end")]
    assert [tuple(r) for r in rows] == want


def test_landed_files_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    texts = [(i, f"line {i}\nof {i}" if i % 7 else "") for i in range(90)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(ingest, "ROWS_PER_FILE", 10)
    landed = []
    listed = pages.list_files
    monkeypatch.setattr(pages, "list_files", lambda *args: landed.append(listed(*args)) or landed[-1])
    got = ingest.extract_new_files(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in got) == sorted(line for _, t in texts for line in t.split("\n"))
    assert listed(spark, os.path.dirname(landed[-1].first().path[len("file:") :]), "*.txt").count() == 10
