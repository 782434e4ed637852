import json

import pytest
from pyspark.sql import functions as F

from tarn.operators import cases
from tarn.operators import corpus_qa as Q
from tarn.operators.chunking import fixed_size, section_raw
from tarn.sources import markdown, tables
from tarn.streaming.ingest import document_stream, index_stream


def test_markdown_corpus(spark, tmp_path):
    root = tmp_path / "kb"
    (root / "ch01").mkdir(parents=True)
    (root / "a.md").write_text('---\ntitle: "A: x"\n skip: 1\ntitle: "B"\n---\n# 第一章 T\nbody\n')
    (root / "ch01" / "s01.md").write_text("---\nnever: closed\ntext")
    (root / "_index.md").write_text("hidden")
    got = {r.source: r for r in markdown.read_markdown(spark, str(root)).collect()}
    assert set(got) == {"a.md", "ch01/s01.md"}
    assert got["a.md"].metadata == {"title": "B"} and got["a.md"].text == "# 第一章 T\nbody"
    assert got["ch01/s01.md"].metadata == {} and got["ch01/s01.md"].text.startswith("---")
    assert [r.source for r in markdown.read_markdown(spark, str(root), skip_dirs=("ch01",)).collect()] == ["a.md"]
    docs = markdown.read_markdown(spark, str(root)).select(F.lit(1).alias("doc_id"), "text", F.col("source").alias("title"))
    chunks = section_raw(docs)
    manifest = markdown.manifest_of(chunks).first()
    assert (manifest.source_id, manifest.char_count) == ("ch01_s01_chunk_01", 4)
    out = markdown.rendered(chunks).first()
    assert out.value == '---\nsource_id: ch01_s01_chunk_01\nchapter_id: ch01\nsection_id: s01\nchunk_index: 1\nchunk_count: 1\nchapter_title: "第一章 T"\nsection_title: ""\ntitle: "第一章 T"\n---\n\n# 第一章 T\n\nbody\n'
    assert markdown.read_manifest(spark, str(tmp_path / "none.json")).count() == 0


def test_manifest_chunks(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"source_id":"x","path":"f.md","title":"M"},{"source_id":"y","path":"gone.md"},{"source_id":"z"}]')
    manifest = markdown.read_manifest(spark, str(tmp_path / "m.json"))
    files = spark.createDataFrame([("f.md", "# H\nkeep\n## I\n### J", {"title": "front", "chunk_index": "3", "chunk_count": "x"})], "source string, text string, metadata map<string,string>")
    rows = markdown.manifest_chunks(manifest, files).collect()
    assert [(r.source, r.content, r.title, r.chunk_index, r.chunk_count) for r in rows] == [("f.md", "keep\n### J", "M", 3, None)]


CHUNK = "source string, content string, title string, chapter_id string, section_id string, chapter_title string, section_title string, source_id string, chunk_index int, chunk_count int"


def test_saved_chunks_are_loaded_again(spark, tmp_path):
    rows = [("ch01/s01.md", 'say "x" \\ y\n\nmore', "T: é", "ch01", "s01", "C", "S", "id1", 2, 3), ("plain.md", "text", "plain", None, None, None, None, "id2", 1, 1)]
    root = str(tmp_path / "kb")
    markdown.save_chunks(spark.createDataFrame(rows, CHUNK), root)
    assert (tmp_path / "kb" / "plain.md").read_text().endswith("---\n\n# plain\n\ntext\n")
    got = {r.source: r for r in markdown.load_chunks(spark, root).collect()}
    a, b = got["ch01/s01.md"], got["plain.md"]
    assert (a.content, a.title, a.chapter_id, a.section_title, a.source_id, a.chunk_index, a.chunk_count) == (rows[0][1], "T: é", "ch01", "S", "id1", 2, 3)
    assert (b.content, b.title, b.chunk_index) == ("text", "plain", 1)
    chunker = lambda files: files.select("source", "text")
    again = markdown.ingest_corpus(spark, root, chunker)
    assert again.skipped and again.reason == "existing_corpus" and again.chunks.count() == 2 and again.manifest.count() == 2


def test_ingestion_of_folders(spark, tmp_path):
    for folder, name in (("sample", "a.md"), ("private/ch00", "front.md"), ("private/ch01", "b.md"), ("extra", "c.md")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text(f"# 第一章 T\ntext of {name}\n")

    def chunker(files):
        return section_raw(files.select(F.xxhash64("source").alias("doc_id"), "text", F.col("source").alias("title"))).withColumn("source", F.col("source"))

    done = markdown.ingest_corpus(spark, str(tmp_path / "kb"), chunker, str(tmp_path / "sample"), str(tmp_path / "private"))
    assert not done.skipped and sorted(r.content for r in done.chunks.collect()) == ["text of a.md", "text of b.md"]
    assert not (tmp_path / "kb").exists()
    done = markdown.ingest_corpus(spark, str(tmp_path / "kb"), chunker, paths=[str(tmp_path / "extra")])
    assert [r.content for r in markdown.load_chunks(spark, str(tmp_path / "kb")).collect()] == ["text of c.md"] and done.manifest.first().path == "ch01/s01.md"
    assert markdown.ingest_corpus(spark, str(tmp_path / "kb"), chunker).skipped


def test_metadata_of_chunks(spark):
    manifest = spark.createDataFrame([("x", "a.md", 1), ("x", "b.md", 2), (None, "c.md", 3), ("z", None, 4)], "source_id string, path string, at int")
    paths = markdown.paths_of(manifest, "at")
    assert [tuple(r) for r in paths.collect()] == [("x", "b.md")]
    semantic = spark.createDataFrame([("x", '{"summary": " said ", "inferred": {"tags": ["t"]}}', 1), ("x", '{"summary": ""}', 2), ("y", '{"summary": "lost"}', 3)], "source_id string, record string, at int")
    found = markdown.metadata_by_path(semantic, paths, F.trim(F.coalesce(markdown.nested(F.col("record"), "summary"), F.lit(""))), "at")
    chunks = spark.createDataFrame([("b.md", "B", None, "", "one"), ("d.md", "D", "C", "S", "two")], "source string, title string, chapter_title string, section_title string, content string")
    assert {r.source: r.metadata_text for r in markdown.with_metadata(chunks, found).collect()} == {"b.md": "said", "d.md": ""}
    assert semantic.select(markdown.nested(F.col("record"), "summary.deeper").alias("n")).first().n is None
    assert [r.source for r in markdown.without_sources(chunks, ("b.md",)).collect()] == ["d.md"]
    assert [r.t for r in chunks.select(markdown.embedding_text().alias("t")).collect()] == ["B\none", "C\nS\nD\ntwo"]


def test_json_files_and_upserts(spark, tmp_path):
    path = str(tmp_path / "out" / "m.json")
    rows = spark.createDataFrame([("a", None), ("é", [1, 2])], "k string, v array<int>")
    for _ in range(2):
        tables.write_json_array(rows, path)
    assert sorted(json.loads((tmp_path / "out" / "m.json").read_text()), key=lambda r: r["k"]) == [{"k": "a", "v": None}, {"k": "é", "v": [1, 2]}]
    tables.write_json_array(rows.limit(0), path)
    assert json.loads((tmp_path / "out" / "m.json").read_text()) == [] and len(list((tmp_path / "out").iterdir())) == 1
    first = spark.createDataFrame([("p", 1, [("s", 0.5)]), ("q", 1, None)], "id string, at int, found array<struct<source:string,score:double>>")
    tables.upsert(first, str(tmp_path / "t"), "id", "at")
    got = {r.id: (r["at"], r.found) for r in tables.upsert(first.filter("id = 'p'").withColumn("at", F.lit(2)), str(tmp_path / "t"), "id", "at").collect()}
    assert got == {"p": (2, '[{"source":"s","score":0.5}]'), "q": (1, None)}


def test_cases(spark, tmp_path):
    text = "front\n# 第二章 T\nlead\n## a\none\n\ntwo\nmore\n# 附录\n## b\nthree\n# 第三章\n## c\n\n# 第十章\nx"
    sections = cases.raw_sections(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"))
    got = {(r.chapter_id, r.section_id): r.paragraphs for r in sections.collect()}
    assert got == {("ch02", "s01"): ["one", "two\nmore\n# 附录"], ("ch02", "s02"): ["three"], ("ch03", "s01"): ["# 第十章\nx"]}
    (tmp_path / "c.json").write_text('[{"case_id": "k1", "expected": [{"chapter_id": "ch02", "section_id": "s01", "start": 0, "end": 2}]}, {"case_id": "k2", "expected": []}]')
    schema = "case_id string, expected array<struct<chapter_id:string,section_id:string,start:int,end:int>>"
    loaded = cases.load_cases(spark, str(tmp_path / "c.json"), schema, 2)
    assert [r.text for r in Q.evidence_of(loaded, sections).collect()] == ["one\n\ntwo\nmore\n# 附录"]
    with pytest.raises(ValueError):
        cases.load_cases(spark, str(tmp_path / "c.json"), schema, 48)
    assert cases.only_cases(loaded, ["k2"]).count() == 1 and cases.only_cases(loaded, []).count() == 2
    with pytest.raises(ValueError):
        cases.only_cases(loaded, ["k3"])
    splits = spark.createDataFrame([("k1", "dev"), ("k2", "test"), ("k2", "dev")], "case_id string, split string")
    assert cases.with_split(loaded.filter("case_id = 'k1'"), splits).first().split == "dev"
    for some in ("k2",), ("k9",):
        with pytest.raises(Exception, match="no single split"):
            cases.with_split(spark.createDataFrame([some], "case_id string"), splits).collect()
    assert sorted(map(tuple, cases.id_differences(loaded, splits.limit(1)).collect())) == [("k2", "left")]


def test_restored_results(spark, tmp_path):
    report = {"strategies": {"raw": {"cases": [{"case_id": "k", "top_k_chunks": [{"source": "a.md", "score": 0.5}, {"source": "b.md", "score": 0.25}, {"source": "c.md"}]}]}}}
    (tmp_path / "r.json").write_text(json.dumps(report))
    ranked = cases.saved_results(spark, str(tmp_path / "r.json"), "raw", "source:string,score:double", 2)
    assert [tuple(r) for r in ranked.collect()] == [("k", 1, "a.md", 0.5), ("k", 2, "b.md", 0.25)]
    with pytest.raises(Exception, match="no usable results"):
        cases.saved_results(spark, str(tmp_path / "r.json"), "raw", "source:string", 4).collect()
    chunk = lambda source, title="T": (source, 1, "C", "S", title, "text")
    corpus = lambda *rows: spark.createDataFrame(rows, "source string, chunk_index int, chapter_title string, section_title string, title string, content string")
    assert [(r["rank"], r.title) for r in cases.restore(ranked, corpus(chunk("a.md"), chunk("b.md", "U"))).orderBy("rank").collect()] == [(1, "T"), (2, "U")]
    for rows, said in (([chunk("a.md")], "cannot restore b.md"), ([chunk("a.md"), chunk("a.md"), chunk("b.md")], "cannot restore a.md"), ([chunk("a.md", ""), chunk("b.md")], "lacks a field")):
        with pytest.raises(Exception, match=said):
            cases.restore(ranked, corpus(*rows)).collect()


def test_tables(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "x"), ("b", "yy")], "source_id string, content string")
    tables.write_vector_index(chunks, lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float")), str(tmp_path / "v"))
    assert tables.read_vector_index(spark, str(tmp_path / "v")).count() == 2
    assert tables.exists(spark, str(tmp_path / "v")) and not tables.exists(spark, str(tmp_path / "w"))
    tables.append_log(chunks, str(tmp_path / "log"))
    tables.append_log(chunks, str(tmp_path / "log"))
    assert tables.read_jsonl(spark, str(tmp_path / "log"), "source_id string, content string").count() == 4
    summary = spark.createDataFrame([("m1", "hit", 0.5), ("m2", "hit", 0.75)], "method string, metric string, mean double")
    assert "| m2 | **0.750** |" in tables.markdown_table(summary, ["hit"])


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta alpha", "t"), (2, "beta gamma", "t")], "doc_id long, text string, title string").withColumn("ts", F.current_timestamp())
    docs.write.parquet(str(tmp_path / "in"))
    query = index_stream(document_stream(spark, str(tmp_path / "in")), lambda d: fixed_size(d, 900), str(tmp_path / "out"), str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out/postings")).filter("term = 'alpha'").first().tf == 2
