"""Sources, sinks, services, the dataset pipeline and streams, without a network."""

from __future__ import annotations

import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from silkloom import cache, services
from silkloom.functions import responses
from silkloom.plans import dataset, generation
from silkloom.sources import files, remote, sinks
from silkloom.streaming import texts


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n  two \n", encoding="utf-8")
    assert [r.text for r in files.load_text(spark, str(tmp_path / "a.txt")).collect()] == ["one", "two"]
    (tmp_path / "b.conll").write_text("a X\nb Y\n\nc Z", encoding="utf-8")
    conll = files.load_text(spark, str(tmp_path / "b.conll"), "conll")
    assert [r.text for r in conll.collect()] == ["a X\nb Y", "c Z"]
    assert files.validate(conll, "conll").first()[0] and not files.validate(spark.createDataFrame([("a",)], "text string"), "conll").first()[0]
    m = files.metadata(conll, "conll").first()
    assert (m.n_samples, m.vocab_size, m.avg_length) == (2, 3, 1.5)
    (tmp_path / "c.json").write_text(json.dumps({"k": "v", "n": 3}), encoding="utf-8")
    assert sorted(r.text for r in files.load_text(spark, str(tmp_path / "c.json"), "json").collect()) == ["3", "v"]
    (tmp_path / "d.txt").write_bytes("é".encode("latin-1"))
    assert files.load_text(spark, str(tmp_path / "d.txt"), encoding="ISO-8859-1").first().text == "é"
    with pytest.raises(FileNotFoundError):
        files.load_text(spark, str(tmp_path / "none.txt"))
    with pytest.raises(ValueError):
        files.load_text(spark, str(tmp_path / "a.txt"), "xml")


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello", encoding="utf-8")
    (tmp_path / "b.bin").write_bytes(b"\x00")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>p1</w:t></w:r></w:p><w:p><w:r><w:t>p2</w:t></w:r></w:p></w:body></w:document>')
    rows = {r.title: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "hello" and rows["c.docx"].text == "p1\np2" and "unsupported" in rows["b.bin"].error
    path = files.list_files(spark, str(tmp_path), "*.txt").first()
    assert path.paper_id == str(uuid.uuid5(uuid.NAMESPACE_URL, path.path)) and path.extension == ".txt"
    assert files.documents(spark, str(tmp_path)).count() == 2


def wiki(url, params):
    if params.get("list") == "search":
        return json.dumps({"query": {"search": [{"pageid": 7, "title": "T", "snippet": '<span class="searchmatch">x</span> y'}]}})
    return json.dumps({"query": {"pages": {"7": {"extract": "body"}}}})


def feed(url, params):
    if url.startswith("rss"):
        return "<rss><channel><item><title>Big News</title><description>d</description><link>http://n/1</link><pubDate>today</pubDate></item><item><title>other</title><description>z</description><link>l</link></item></channel></rss>"
    return b"<nav>m</nav><p>the text</p>"


def test_remote(spark):
    queries = spark.createDataFrame([("q",)], "query string")
    source = remote.WikipediaSource(get=wiki, pause=0)
    assert source.search(queries).first().snippet == "x y"
    assert tuple(source.documents(queries).first()) == ("wiki_7", "T", "body", "wikipedia_th")
    news = remote.NewsSource({"s": "rss://s"}, get=feed)
    docs = news.documents(spark, "NEWS").collect()
    assert len(docs) == 1 and docs[0].text == "the text" and docs[0].source == "s_today"

    def papers(url, params):
        return b"%PDF" if "pdf" in url else '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://a/abs/1</id><title>P</title><summary>s</summary><published>2020-01-02T00:00:00Z</published><author><name>A</name></author><link title="pdf" href="http://a/pdf/1"/></entry></feed>'

    paper = remote.ArxivSource(get=papers, pause=0).documents(queries, lambda b: b.decode()).first()
    assert paper.paper_id == "1" and paper.text == "%PDF" and paper.authors == ["A"]


def test_failed_fetch_is_a_row(spark):
    def broken(url, params):
        raise OSError("down")

    row = remote.WikipediaSource(get=broken, pause=0).search(spark.createDataFrame([("q",)], "query string")).first()
    assert row.page_id is None and "down" in row.error


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], "train"), (2, ["b"], "test")], "id int, x array<string>, split string")
    for kind in sinks.FORMATS:
        path = sinks.save_dataset(df, str(tmp_path), "task", kind, kind)
        assert spark.read.format("csv" if kind == "csv" else "parquet" if kind == "parquet" else "json").option("header", True).option("multiLine", kind == "json").load(path).count() == 2
    with pytest.raises(ValueError):
        sinks.save_dataset(df, str(tmp_path), "task", "xml")
    sinks.save_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/parquet")).count() == 2
    q = {r.id: r.quality_a for r in sinks.with_quality(df, {"a": 0.5, "b": None}).collect()}
    assert q == {1: 0.5, 2: None}
    assert "### total_words" in sinks.to_report({"total_words": 3}) and "<h3>total_words</h3>" in sinks.to_report({"total_words": 3}, "html")
    with pytest.raises(ValueError):
        sinks.to_report({}, "pdf")


def test_one_array(spark, tmp_path):
    rows = [(i, f'é "{i}"\n', None if i % 3 else [i]) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, text string, x array<int>").repartition(7)
    path = sinks.save_dataset(df.orderBy("id"), str(tmp_path), "task", stamp="a")
    assert json.loads(open(path, encoding="utf-8").read()) == [{"id": i, "text": t, "x": x} for i, t, x in rows]
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["task_a.json"]
    sinks.save_array(df.where("id < 0"), path)
    assert json.loads(open(path).read()) == []


def test_answers_are_kept(spark, tmp_path):
    """A second fetch asks for nothing; failures are asked again; looking keys up does not shuffle the table."""
    log = tmp_path / "log"

    def counted(url, params):
        with open(log, "a") as f:
            f.write(f"{params}\n")
        if "down" in str(params):
            raise OSError("down")
        return wiki(url, params)

    asked = lambda: len(log.read_text().splitlines()) if log.exists() else 0
    kept = cache.AnswerCache(spark, "answers", buckets=8)
    source = remote.WikipediaSource(get=counted, pause=0, cache=kept)
    queries = spark.createDataFrame([("q",), ("q",), ("down",), (None,)], "query string")
    first = sorted(map(repr, source.search(queries).collect()))
    assert asked() == 3 and len(first) == 4
    again = sorted(map(repr, source.search(queries).collect()))
    assert asked() == 4 and again == first  # only what was down
    assert tuple(source.documents(queries.where("query = 'q'")).first()) == ("wiki_7", "T", "body", "wikipedia_th")
    before = asked()
    assert source.documents(queries.where("query = 'q'")).count() == 1 and asked() == before
    assert source.search(queries.where("query = 'q'"), limit=3).count() == 1 or asked() == before + 1

    keys = spark.createDataFrame([(f"k{i}",) for i in range(50)], "key string")
    for day in ("2020-01-01", "2021-01-01"):
        kept.put(keys.where("key < 'k3'").selectExpr("key", f"concat(key, '-{day}') as value", f"timestamp'{day}' as timestamp"))
    want = {f"k{i}": f"k{i}-2021-01-01" if f"k{i}" < "k3" else None for i in range(50)}
    for _ in range(2):
        probe = kept.probe(keys)
        assert {r.key: r.value for r in probe.collect()} == want
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = kept.probe(keys)._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "Join" in plan and plan.count("Exchange") == 1 and "Exchange" not in plan[plan.index("Aggregate") :], plan
        n = spark.table("answers").count()
        kept.compact()
    assert spark.table("answers").count() == spark.table("answers").select("key").distinct().count() <= n
    old = cache.AnswerCache(spark, "answers", buckets=8, ttl="1 day")
    assert old.probe(keys).where("value is not null").count() == 0


def test_models_are_asked_once(spark, tmp_path):
    log = tmp_path / "log"

    def model(prompt):
        with open(log, "a") as f:
            f.write("x")
        return client(prompt)

    kept = cache.AnswerCache(spark, "said", buckets=4, ttl="1 day")
    prompts = spark.createDataFrame([("good", 1), ("good", 2), ("bad", 3), (None, 4)], "prompt string, n int")
    for times in (2, 3):
        rows = {r.n: r for r in services.ask_through(prompts, model, kept, "s", "m").collect()}
        assert rows[1].response == rows[2].response and "good" in rows[1].response and "no" in rows[3].error and rows[4].error
        assert len(log.read_text()) == times  # the failed one is asked again


def client(prompt):
    if "bad" in prompt:
        raise RuntimeError("no")
    return f"คะแนน: 0.9\nความรุนแรง: 1\n{prompt}"


def test_services(spark):
    prompts = spark.createDataFrame([("good",), ("bad",), (None,)], "prompt string")
    rows = {r.prompt: r for r in services.ask(prompts, client).collect()}
    assert rows["good"].response and "no" in rows["bad"].error
    assert services.with_fallback({"x": lambda p: 1 / 0, "y": lambda p: "ok"})("p") == "ok"
    assert services.with_fallback({"x": lambda p: 1 / 0})("p") is None
    assert services.verify_access({"x": lambda p: 1 / 0, "y": lambda p: "ok"}) == {"x": False, "y": True}
    assert services.request_payload("chat", "m", "p")["messages"] == [{"role": "user", "content": "p"}]
    assert services.read_answer("inference", [{"generated_text": "t"}]) == "t" and services.read_answer("generate", {"response": "r"}) == "r"
    known = spark.createDataFrame([], services.CACHE)
    some = prompts.where("prompt = 'good'")
    told, known = services.ask_cached(some, client, known, "s", "m")
    assert told.first().response and known.count() == 1
    old = spark.sql("select 's:m:good' as key, 'stale' as value, timestamp'2020-01-01' as timestamp")
    assert services.cached(old.select("key"), old).first().value is None
    assert services.upsert(known, old).first().value != "stale"


def test_generation(spark):
    texts_df = spark.createDataFrame([(1, "t1"), (2, "t2 bad"), (3, "t3 part")], "doc_id int, text string")

    def answer(prompt):
        if "bad" in prompt:
            raise RuntimeError("no")
        return '```json\n{"text": "t"}\n```' if "part" in prompt else '{"text": "t", "label": "positive", "label_id": 1, "confidence": 0.5}'

    rows = {r.doc_id: r for r in generation.generate(texts_df, generation.text_classification(), answer, 3).collect()}
    assert rows[1].sample.label == "positive" and rows[1].error is None
    assert "no" in rows[2].error and rows[3].error.startswith("Missing")
    named = "text_classification token_classification question_answering summarization translation sentence_similarity fill_mask zero_shot_classification text_generation text2text_generation feature_extraction"
    assert set(generation.TASKS) == set(named.split())
    for task in generation.TASKS.values():
        assert set(task().required) <= set(spark.createDataFrame([], task().schema).columns)


def obedient(prompt):
    """Answers with the lines that the prompt asks for, and knows nothing else."""
    wanted = [line for line in prompt.split("\n") if ": <" in line]
    return "\n".join(line.split(": <")[0] + ": " + {"0-1>": "0.9", "1-5>": "1", "text>": "x"}[line.split(": <")[1]] for line in wanted)


def test_dual_prompts_ask_for_what_is_read(spark):
    df = spark.createDataFrame([(i, f"a perfectly fine text {i}", f"l{i % 2}") for i in range(4)], "id int, text string, label string")
    report = dataset.process_dataset(df, "text_classification", client=obedient)
    assert report["validation"]["dual_validation"]["average_score"] == pytest.approx(0.94)
    seen = df.select(responses.generator_prompt("text", "qa").alias("g"), responses.critic_prompt(F.to_json(F.struct("text", "label")), "qa").alias("c")).first()
    assert "fine text 0" in seen.g and '"label":"l0"' in seen.c and "qa" in seen.g and "qa" in seen.c


def test_dataset_pipeline_and_tasks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a perfectly fine text {i}", f"l{i % 2}") for i in range(10)], "id int, text string, label string")
    report = dataset.process_dataset(df, "text_classification", client=client)
    assert report["summary"]["overall_quality_score"] > 0.9 and report["summary"]["meets_quality_threshold"]
    assert report["validation"]["dual_validation"]["average_score"] == pytest.approx(0.94)
    loop = dataset.TaskLoop(spark, lambda c, n: (df, "text_classification", "id"), str(tmp_path / "check"))
    result = loop.run_task(dataset.TaskConfig("text_classification", output_dir=str(tmp_path / "out")), "t1")
    assert result.status == "success" and spark.read.json(result.dataset_path, multiLine=True).count() == 10
    again = dataset.TaskLoop(spark, lambda c, n: 1 / 0, str(tmp_path / "check"))
    again.load()
    assert again.run_task(dataset.TaskConfig("text_classification"), "t1").status == "success"
    assert again.run_task(dataset.TaskConfig("ner"), "t2").status == "error"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a  b!", 1, "2024-01-01 00:01:00"), ("a  b!", 2, "2024-01-01 00:02:00"), ("null value text", 3, "2024-01-01 00:21:00")], "text string, label int, t string").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    schema = "text string, label int, t timestamp"
    cleaned = texts.checked(texts.cleaned(texts.read_stream(spark, str(tmp_path / "in"), schema)), "text_classification")
    q = texts.to_parquet(cleaned, str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable(), q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 3 and got.where("is_valid").count() == 0
    counts = texts.windowed_counts(texts.read_stream(spark, str(tmp_path / "in"), schema), "t")
    q = counts.writeStream.format("memory").queryName("w").outputMode("update").start()
    q.processAllAvailable(), q.stop()
    assert sorted(r.n_words for r in spark.sql("select * from w").collect()) == [3, 4]
    once = texts.first_seen(texts.read_stream(spark, str(tmp_path / "in"), schema), "t")
    q = once.writeStream.format("memory").queryName("o").start()
    q.processAllAvailable(), q.stop()
    assert spark.sql("select * from o").count() == 2


def test_process_text(spark):
    from silkloom.plans import documents

    df = spark.createDataFrame([(1, "Abstract\nWe, do this. " + "Then more words follow here. " * 60 + "\nIntroduction\nค่า")], "doc_id int, text string")
    out = documents.process_text(df, thai_text=True)
    row = out.first()
    assert row.stats.chunk_count == len(row.chunks) == 2 and row.stats.sentence_count == len(row.sentences) == 62
    assert row.sections.abstract.startswith("We, do") and row.thai_metrics.tonal.tone_1 == 1 and row.stats.cleaning_stats.special_chars_removed == 2
    scored = documents.validate_sentences(out, client)
    assert scored.count() == 62 and scored.where("needs_revision").count() == 0
    both = documents.analyze(df.union(df.withColumn("doc_id", F.lit(2)))).first()
    assert both.near_duplicate_pairs == 1 and both.redundancy_rate == 1.0 and both.total_words > 300
