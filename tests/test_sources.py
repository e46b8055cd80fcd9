"""Readers and writers on small files."""

import gzip
import json

import pytest

from penstroke import staging
from penstroke.sources import readers as I
from penstroke.sources import writers as O
from tests.conftest import rows


def test_json(spark, tmp_path):
    lines = [{"author": f"a{i}", "body": f"t\n{i}", "more": i} for i in range(30)]
    (tmp_path / "c.json").write_text("\n".join(json.dumps(x) for x in lines))
    got = I.read_json_corpus(spark, str(tmp_path / "c.json"), "reply")
    assert rows(got) == sorted(((f"a{i}", f"t\n{i}", f"reply_{i}", "reply") for i in range(30)), key=repr)


def test_positions_over_many_splits(spark, tmp_path):
    """Several files, cut into many splits that are read in another order; blank lines have no position."""
    at = 0
    for name, n in (("a", 40), ("b", 900), ("c", 300)):
        lines = []
        for i in range(n):
            lines.append(json.dumps({"author": f"x{at}", "body": "t" * (at % 50)}))
            lines += [""] * (i % 97 == 5)
            at += 1
        (tmp_path / f"{name}.json").write_text("\n".join(lines) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = I.read_json_corpus(spark, str(tmp_path), "r").collect()
        scan = spark.read.schema("author string").json(str(tmp_path))
        assert scan.rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(got) == at and all(r.doc_id == f"r_{r.author[1:]}" for r in got)


def test_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text('id,topic,text\n7,x,"a ""q""\nb"\n8,y, plain \n')
    got = I.read_csv_corpus(spark, str(tmp_path / "b.csv"), ["id", "topic", "text"], "blog")
    assert rows(got) == [("7", 'a "q"\nb', "blog_0", "blog"), ("8", " plain ", "blog_1", "blog")]


def test_tsv(spark, tmp_path):
    (tmp_path / "a.txt").write_text('1\t10\the said "x\tMon\n2\t11\n3\t12\ta\tb\tc\td\n4\t13\t\tTue\n\nnan\t14\tNA\tWed\n')
    (tmp_path / "b.txt").write_text("5\t15\tlast\tThu\n")
    paths = [str(tmp_path / n) for n in ("a.txt", "b.txt", "none.txt")]
    want = [("1", 'he said "x', "10"), ("2", "", "11"), ("4", "", "13"), ("5", "last", "15"), ("nan", "", "14")]
    assert rows(I.read_tsv_headerless(spark, paths, "tweet")) == sorted(((*w, "tweet") for w in want), key=repr)
    with pytest.raises(FileNotFoundError):
        I.read_tsv_headerless(spark, paths[2:], "tweet")


def test_books(spark, tmp_path):
    (tmp_path / "meta.csv").write_text("id,author,language\nPG1,\"Twain, M\",\"['en']\"\nPG2,Anon,\"['fr']\"\nPG3,Void,\"['en']\"\n")
    books = tmp_path / "books"
    books.mkdir()
    (books / "PG1_text.txt").write_text("line one\nline two\n")
    (books / "other.txt").write_text("x")
    (books / "deep er").mkdir()
    (books / "deep er" / "PG3_text.txt").touch()
    meta = I.read_metadata(spark, str(tmp_path / "meta.csv"))
    files = I.read_text_files(spark, str(books))
    found, missing = I.join_metadata_files(meta, files)
    assert rows(found) == [("PG1", "Twain, M", "['en']", "line one\nline two\n"), ("PG3", "Void", "['en']", "")]
    assert rows(I.list_files(spark, str(books)), "id", "length") == [("PG1", 18), ("PG3", 0)]
    assert rows(missing) == [("PG2", "Anon", "['fr']")]


def test_many_files(spark, tmp_path):
    """Files are dealt to folders that Spark lists in tasks, and the listing reaches no Python; compressed files are unpacked."""
    texts = [(f"book={i}/part.txt", "" if i % 7 == 0 else f"text\n{i} \u00e9") for i in range(300)]
    O.write_text_files(spark.createDataFrame([*texts, (None, "x")], "name string, text string"), str(tmp_path / "b"))
    assert len(list((tmp_path / "b").iterdir())) > 32
    assert not list((tmp_path / "b").rglob(".*"))
    (tmp_path / "b" / "book=999").mkdir()
    with gzip.open(tmp_path / "b" / "book=999" / "part.txt.gz", "wt") as packed:
        packed.write("unpacked")
    pattern = r"book=(\d+)/"
    read = I.read_text_files(spark, str(tmp_path / "b"), pattern)
    assert rows(read) == sorted([*((str(i), t) for i, (_, t) in enumerate(texts)), ("999", "unpacked")], key=repr)
    sizes = dict(rows(I.list_files(spark, str(tmp_path / "b"), pattern), "id", "length"))
    assert all(sizes[str(i)] == len(t.encode()) for i, (_, t) in enumerate(texts)) and len(sizes) == 301
    assert "ExistingRDD" not in read._jdf.queryExecution().executedPlan().toString()


def test_ids_of_files_are_found_without_their_contents(spark, tmp_path):
    O.write_text_files(spark.createDataFrame([("1_text.txt", "x")], "name string, text string"), str(tmp_path / "b"))
    _, missing = I.join_metadata_files(spark.createDataFrame([("1",), ("2",)], "id string"), I.read_text_files(spark, str(tmp_path / "b")))
    shape = missing._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in shape and "Format: Text" not in shape and "content" not in shape
    assert rows(missing) == [("2",)]


def test_counts(spark, tmp_path):
    counts = spark.createDataFrame([("the", 5), ('a"b', 2), ("zero", 0)], "key string, n bigint")
    O.write_counts(counts, str(tmp_path / "p"))
    O.write_counts_json(counts, str(tmp_path / "j"))
    want = [("a\"b", 2), ("the", 5)]
    assert rows(I.read_counts(spark, str(tmp_path / "p"))) == sorted(want, key=repr)
    assert rows(I.read_counts_json(spark, str(tmp_path / "j"))) == sorted(want, key=repr)
    (tmp_path / "one.json").write_text('{"the": 5, "key": 3,\n "n": 1}')
    assert rows(I.read_counts_json(spark, str(tmp_path / "one.json"))) == [("key", 3), ("n", 1), ("the", 5)]
    O.write_counts_json(counts.limit(0), str(tmp_path / "none"))
    assert rows(I.read_counts_json(spark, str(tmp_path / "none"))) == []


def test_missing_markers_in_comma_separated_files(spark, tmp_path):
    (tmp_path / "blogs.csv").write_text('id,text\nNA,first\nann,"second, part"\n')
    read = I.read_csv_corpus(spark, str(tmp_path / "blogs.csv"), ["id", "text"], "blog")
    assert rows(read, "author", "text") == sorted([(None, "first"), ("ann", "second, part")], key=repr)


def test_verification_columns_are_found_by_name(spark, tmp_path):
    for part in ("train", "test"):
        (tmp_path / f"{part}_corpus.csv").write_text('id,text,author,texttype,corpus\n1,"a ""b""\nc",ann,known,c0\n')
        (tmp_path / f"{part}_problems.csv").write_text("unknown_author,corpus,known_author\nbob,c0,ann\n")
    tables = I.read_verification_tables(spark, str(tmp_path))
    assert rows(tables["train_corpus"]) == [("c0", "ann", "known", 'a "b"\nc', 0, "train_0")]
    assert rows(tables["test_problems"]) == [("c0", "ann", "bob")]
    (tmp_path / "test_problems.csv").write_text("corpus,known_author\nc0,ann\n")
    with pytest.raises(ValueError):
        I.read_verification_tables(spark, str(tmp_path))


def test_missing_fields_of_verification_tables(spark, tmp_path):
    for part in ("train", "test"):
        (tmp_path / f"{part}_corpus.csv").write_text('corpus,author,texttype,text\nc0,NA,known,x\nc0,ann,known,\nc0,ann,unknown,null\n')
        (tmp_path / f"{part}_problems.csv").write_text("corpus,known_author,unknown_author\nNaN,ann,ann\n")
    tables = I.read_verification_tables(spark, str(tmp_path))
    got = [tuple(r) for r in tables["test_corpus"].orderBy("pos").collect()]
    assert got == [("c0", None, "known", "x", 0, "test_0"), ("c0", "ann", "known", "nan", 1, "test_1"), ("c0", "ann", "unknown", "nan", 2, "test_2")]
    assert rows(tables["train_problems"]) == [(None, "ann", "ann")]


def test_corpora_of_a_query_prune_the_scan(spark, tmp_path):
    chunks = spark.createDataFrame([(f"a{i}", "d", f"s{i % 5}", i, [0, 2], [-1, -1]) for i in range(40)], I.CHUNK_SCHEMA)
    O.write_parquet(chunks, str(tmp_path / "c"), ["source"])
    sizes = spark.createDataFrame([(f"s{i}", i) for i in range(5)], "source string, n int")
    got = I.read_corpora(spark, str(tmp_path / "c"), sizes.where("n > 3"), ["author"])
    shape = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in shape and "ReadSchema: struct<author:string>" in shape
    assert rows(got, "author") == sorted(((f"a{i}",) for i in range(40) if i % 5 == 4), key=repr)


def test_empty_predictions_are_not_written(spark, tmp_path):
    empty = spark.createDataFrame([], "known_author string")
    assert not O.write_predictions_csv(empty, str(tmp_path / "e"))
    assert not O.write_predictions_csv(None, str(tmp_path / "e"))
    assert not (tmp_path / "e").exists()


def test_stage(spark):
    df = spark.range(10)
    assert rows(staging.stage(df)) == rows(df)
    assert staging.shared_folder(spark) == staging.shared_folder(spark)
    assert "Range" not in staging.stage(df)._jdf.queryExecution().executedPlan().toString()
