import json
import os

import pytest
from pyspark.sql import functions as F

from lorequery.sources import csv_splits, faq_csv, tables
from lorequery.sources.collection import add_documents, read_collection, to_documents
from lorequery.sources.events import add_event_files, fold_events, parsed_event, read_event_files, read_lines, token_events, write_events
from lorequery.streaming.events import fold_stream, read_folded
from lorequery.operators.embedding import hash_embedder

HANDBOOK = os.path.join(os.path.dirname(__file__), "data", "handbook.csv")


def test_scan_and_normalise(spark):
    rows = [tuple(r) for r in faq_csv.preprocess_csv(spark, HANDBOOK).collect()]
    assert rows == [
        ("Where is the spare key kept?", "In the grey box, next to the door.", "Front desk"),
        ("How do i book the van? is it free?", 'Ask the "fleet" desk\nbefore noon.', "Fleet"),
        ("When does the canteen open?", "At eight.", None),
        ("Who waters the plants?", None, "Garden"),
        (None, "Nobody asked this.", None),
        ("How do i reset the alarm?", "Hold * and 5, then wait.", "Front desk"),
    ]


def test_missing_file_and_missing_column(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        faq_csv.read_qa_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="Answer"):
        faq_csv.normalize_qa(spark.createDataFrame([("x",)], "Question string"))


def test_null_tokens(spark):
    df = spark.createDataFrame([(t,) for t in [*faq_csv.NULL_TOKENS, " ", "Na", "nullx"]], "s string")
    kept = [r[0] for r in df.select(faq_csv.null_if_missing(F.col("s"))).collect() if r[0] is not None]
    assert kept == [" ", "Na", "nullx"]


def test_csv_round_trip(spark, tmp_path):
    rows = [("  lead, and trail  ", 'say "x"\nand \\ more'), ("tab\t", None), ("a", "b")]
    df = spark.createDataFrame(rows, "Question string, Answer string")
    faq_csv.write_qa_csv(df, str(tmp_path / "out"))
    assert sorted(map(str, faq_csv.read_qa_csv(spark, str(tmp_path / "out")).collect())) == sorted(
        map(str, df.collect())
    )


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = spark.range(1), spark.range(2)
    assert tables.write_once(spark, path, lambda: one)
    assert not tables.write_once(spark, path, lambda: two)
    assert spark.read.parquet(path).count() == 1
    assert tables.write_once(spark, path, lambda: two, overwrite=True)
    assert tables.row_count(spark.read.parquet(path)).first().n == 2
    assert tables.has_rows(two) and not tables.has_rows(two.filter("id < 0"))


def test_broken_off_write_is_repeated(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(3).write.parquet(str(path))
    os.replace(path / "_SUCCESS", path / "_half")
    assert tables.write_once(spark, str(path), lambda: spark.range(4))
    assert spark.read.parquet(str(path)).count() == 4


def test_collection_adds_only_new_ids(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = [(0, "q0", "a0"), (1, "q1", "a1"), (2, "q2", None)]
    first = spark.createDataFrame(rows, "doc_pos long, question string, answer string")
    second = spark.createDataFrame(
        [(1, "other", "other"), (3, "q3", "a3"), (3, "again", "b3")], "doc_pos long, question string, answer string"
    )
    add_documents(path, to_documents(first, hash_embedder()))
    for _ in range(2):
        add_documents(path, to_documents(second, hash_embedder()))
    got = sorted((r.id, r.document, r.metadata.question, len(r.embedding)) for r in read_collection(spark, path).collect())
    assert got == [("qa_0", "a0", "q0", 64), ("qa_1", "a1", "q1", 64), ("qa_3", "a3", "q3", 64)]


def test_events_and_back(spark, tmp_path):
    rows = [(1, "s", "a b  c"), (2, "t", ""), (3, "s", 'A: say "x" ü')]
    answers = spark.createDataFrame(rows, "request int, session_id string, answer string")
    events = token_events(answers, "request", "session_id")
    assert [r.json for r in events.filter("request = 1").orderBy("pos").collect()] == [
        '{"token":"a"}', '{"token":"b"}', '{"token":"c"}', '{"final":"a b c","session_id":"s"}',
    ]
    back = {r.request: r.final for r in fold_events(events, "request").collect()}
    assert back == {1: "a b c", 2: "", 3: 'say "x" ü'}
    write_events(events, str(tmp_path / "e"), "request")
    lines = read_lines(spark, str(tmp_path / "e"))
    assert lines.count() == events.count()
    assert {r.request for r in lines.select("request").distinct().collect()} == {1, 2, 3}


def test_lines_come_back_in_order(spark, tmp_path):
    words = [f"w{i}" for i in range(4000)]
    (tmp_path / "a.ndjson").write_text("".join(f'{{"token":"{w}"}}\n' for w in words))
    (tmp_path / "b.ndjson").write_text('{"token":"x"}\n\n{oops\n{"final":"done"}\n{"token":"late"}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = read_lines(spark, str(tmp_path)).withColumnRenamed("value", "json")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {r.file.rsplit("/", 1)[-1]: r.final for r in fold_events(lines, "file").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {"a.ndjson": " ".join(words), "b.ndjson": "donelate"}


def test_event_files(spark, tmp_path):
    path = str(tmp_path / "e")
    assert read_event_files(spark, path, "request int").count() == 0
    first = token_events(spark.createDataFrame([(1, "s", "a b"), (2, None, "")], "request int, session_id string, answer string"), "request", "session_id")
    add_event_files(first, path, "request", n_files=2)
    more = token_events(spark.createDataFrame([(None, "s", 'say "x"\nü')], "request int, session_id string, answer string"), "request", "session_id")
    add_event_files(more, path, "request", n_files=2)
    # a folder that no version names, and a line of another form
    (tmp_path / "e" / "segments" / "half" / "lines").mkdir(parents=True)
    (tmp_path / "e" / "segments" / "half" / "lines" / "part").write_text("junk")
    back = read_event_files(spark, path, "request int")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, first.unionByName(more).select("request", "pos", "json").collect()), key=repr)
    folded = {r.request: r.final for r in fold_events(back, "request").collect()}
    assert folded == {1: "a b", 2: "", None: 'say "x" ü'}


def test_event_files_are_parsed_once(spark, tmp_path):
    path = str(tmp_path / "e")
    answers = spark.createDataFrame([(i, "s", f"a{i} b") for i in range(40)], "request int, session_id string, answer string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        add_event_files(token_events(answers, "request", "session_id"), path, "request", n_files=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    back = read_event_files(spark, path, "request int")
    # all tasks write, not only as many as there are files at least
    assert back.select(F.col("request"), F.input_file_name().alias("file")).select("file").distinct().count() > 2
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(StructField(answer") == 1
    assert {r.request: r.final for r in fold_events(back, "request").collect()} == {i: f"a{i} b" for i in range(40)}


def test_event_files_take_less_room_than_their_lines(spark, tmp_path):
    path = str(tmp_path / "e")
    answers = spark.createDataFrame([(i, "s", " ".join(f"w{j % 9}" for j in range(i))) for i in range(200)], "request int, session_id string, answer string")
    events = token_events(answers, "request", "session_id")
    add_event_files(events, path, "request", n_files=2)
    raw = sum(len(r.json) for r in events.collect())
    stored = sum(f.stat().st_size for f in (tmp_path / "e").rglob("lines/part-*"))
    assert 0 < stored < raw / 4
    back = read_event_files(spark, path, "request int")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, events.select("request", "pos", "json").collect()))


def test_lines_left_out_unparsed_are_no_objects(spark):
    texts = ["}{", "a}{b", 'q"}{"', "\\}{", '\\"}{', "", "{", "}", "' "]
    lines = [json.dumps({key: text}) for key in ("token", "final") for text in texts] + [
        "{}", "{ }", '{\t"token":"x"}', ' {"token":"x"}  ', '\t{"token":"x"}', "{'token':'x'}", '{token:"x"}', "{", "}", "{}{}",
        '{"token":"x"}{"token":"y"}', '{"token":"x"} {"token":"y"}', '{"token":"x"},{"token":"y"}', '{"a":{"b":"}{"},"token":"x"}',
        '{"a":"\\"}{","token":"x"}', '{"token":1}', '{"token":null}', '[{"token":"x"}]', "", " ", None, '{"token":"x"',
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    bare, kind = F.trim("line"), "array<struct<token: string, final: string>>"
    found = F.from_json(F.concat(F.lit("["), "line", F.lit("]")), kind, {"allowSingleQuotes": "false"})
    whole = (F.size("found") == 1) & bare.startswith("{") & bare.endswith("}")
    want = df.select("i", "line", found.alias("found")).select("i", F.when(whole, F.get("found", F.lit(0))).alias("event"))
    got = df.select("i", parsed_event(F.col("line")).alias("event"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_fold_of_a_stream(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = spark.createDataFrame([], "request int, pos int, json string").schema

    def arrive(*lines):
        spark.createDataFrame(list(lines), schema).coalesce(1).write.mode("append").parquet(source)

    def follow():
        fold_stream(spark, source, schema, "request", out, progress, timeout_ms=1).awaitTermination()
        return sorted((r.request, r.final, r.complete) for r in read_folded(spark, out).collect())

    arrive((1, 1, '{"token":"b"}'), (1, 0, '{"token":"a"}'), (2, 0, '{"token":"x"}'), (2, 1, '{"final":"whole"}'), (3, 0, "{oops"), (4, 0, '{"final":"early"}'))
    assert follow() == [(2, "whole", True), (4, "early", True)]
    # answer 1 goes on, 3 has timed out, late and second finals of 2 and 4 change nothing
    arrive((1, 3, '{"final":"a b c"}'), (1, 2, ""), (2, 2, '{"final":"other"}'), (4, 1, '{"token":"late"}'), (5, 0, '{"token":"no"}'), (5, 1, '{"token":"end"}'))
    second = follow()
    assert (1, "a b c", True) in second or (1, "a b", False) in second
    arrive((6, 0, '{"final":"six"}'))
    third = follow()
    assert [r for r in third if r[0] != 1] == [(2, "whole", True), (3, "", False), (4, "early", True), (5, "no end", False), (6, "six", True)]
    assert [r[0] for r in third].count(1) == 1 and follow() == third


def test_fold_of_damaged_lines(spark):
    lines = [
        (1, 0, '{"token":"a"}'), (1, 1, ""), (1, 2, "{oops"), (1, 3, '{"token":"b"}'),
        (2, 0, '{"token":"a"}'), (2, 1, '{"final":"done"}'),
        (3, 0, "nothing usable"), (3, 1, '{"token":"a"} x'), (3, 2, "{'token':'a'}"), (3, 3, '{"token":"a"}{"token":"b"}'),
        (4, 0, '{"final":"first"}'), (4, 1, '{"final":"second"}'),
    ]
    df = spark.createDataFrame(lines, "request int, pos int, json string")
    assert {r.request: r.final for r in fold_events(df, "request").collect()} == {
        1: "a b", 2: "done", 3: "", 4: "second",
    }


RECORDS = (
    'Question,Answer,Tag\n"a, b","x\ny ""q""\n\nz",1\npad,it 5" wide,2\n\n"","\n",3\nshort\nlast,"un""\n,""\n",9\n'
    '"x"tail,k,\nü,"é\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n",4\nq'
)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_splits_equal_one_task(spark, tmp_path, end):
    # each file is a byte longer before the same records: over the files, splits begin at every byte
    width = 37
    for i in range(0, width, 1 if end == "\n" else 5):
        text = RECORDS.replace("pad", "p" * (i + 1)).replace("\n", end)
        (tmp_path / f"f{i:02d}.csv").write_bytes(text.encode())
    whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(str(tmp_path))
    want = sorted(map(repr, whole.collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, str(width)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = csv_splits.read_csv_splits(spark, str(tmp_path), place=("f", "s", "r"))
            rows = df.collect()
            # the one-task reader changes line ends inside values, this one leaves them
            assert sorted(repr(r).replace("\\r\\n", "\\n") for r in df.drop("f", "s", "r").collect()) == want
            assert any("\r" in str(r.Answer) for r in rows) == (end == "\r\n")
            # the place orders the records of each file
            for name in {r.f for r in rows}:
                own = [r.Question for r in sorted(rows, key=lambda r: (r.f, r.s, r.r)) if r.f == name]
                assert [q if q is None or q.strip("p") else "p" for q in own] == ["a, b", "p", None, "short", "last", "xtail" if "xtail" in own else '"x"tail', "ü", "q"]
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
        stale = csv_splits.read_csv_splits(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "19")
        with pytest.raises(Exception, match="have changed"):
            stale.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_splits_report_long_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Question,Answer\n"q, 1",a\nq2,a,more\n"x\n,,",b\n')
    with pytest.raises(Exception, match="more than 2 fields"):
        csv_splits.read_csv_splits(spark, str(tmp_path)).collect()
    cut = csv_splits.read_csv_splits(spark, str(tmp_path), too_long="cut").collect()
    assert sorted(map(tuple, cut)) == [("q, 1", "a"), ("q2", "a"), ("x\n,,", "b")]
    with pytest.raises(FileNotFoundError):
        csv_splits.read_csv_splits(spark, str(tmp_path / "none"))
    (tmp_path / "a.csv").write_text("Question,Answer\n")
    assert csv_splits.read_csv_splits(spark, str(tmp_path)).count() == 0


def test_csv_splits_normalise(spark):
    one = faq_csv.preprocess_csv(spark, HANDBOOK)
    split = faq_csv.preprocess_splits(spark, HANDBOOK, place=("f", "s", "r"))
    assert [tuple(r)[3:] for r in split.orderBy("f", "s", "r").collect()] == [tuple(r) for r in one.collect()]
