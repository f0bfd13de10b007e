"""The command line, and sources and sinks at their edges."""

import json

import pytest
from pyspark.sql import functions as F

from siftwork import cli
from siftwork.plans import catalog
from siftwork.sources import io, scratch

SF = "/root/testdata/sf0.001"


def test_every_verb_names_a_query():
    catalog.load()
    assert {q for verbs in cli.VERBS.values() for q in verbs.values()} <= set(catalog.QUERIES)


def test_verbs_run_and_write(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "classify_job" in capsys.readouterr().out
    assert cli.main(["versions"]) == 0 and "v13.1" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "--data", SF]) == 2
    out = f"{tmp_path}/out"
    assert cli.main(["eval", "labels", "--data", SF, "--out", out]) == 0
    assert {json.loads(r.value)["label"] for r in spark.read.text(out).collect()} == {"good_fit", "maybe", "bad_fit"}
    with pytest.raises(Exception, match="(?i)exist"):
        cli.main(["eval", "labels", "--data", SF, "--out", out])
    with pytest.raises(SystemExit):
        cli.main(["eval", "nothing", "--data", SF])


def test_csv_keeps_line_breaks_quotes_and_drops_the_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Field,Said\n1,\"two\nlines, \"\"quoted\"\"\"\n".encode())
    (r,) = io.read_csv(spark, f"{tmp_path}/a.csv").collect()
    assert r.Field == "1" and r.Said == 'two\nlines, "quoted"'


def test_sources_that_are_absent_are_passed_over(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n')
    found = io.existing(spark, {"a": f"file://{tmp_path}/a.jsonl", "b": f"file://{tmp_path}/b.jsonl"})
    assert list(found) == ["b"]


def test_places_are_numbered_over_gaps_and_negative_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (-5, 3, 900, 10**9, 4)], "k long").repartition(3)
    assert [(r.k, r.place) for r in io.placed(df, "k").orderBy("k").collect()] == [(-5, 1), (3, 2), (4, 3), (900, 4), (10**9, 5)]
    assert io.placed(df.limit(0), "k").collect() == []


def test_scratch_is_an_error_on_a_cluster_without_a_shared_folder(spark, monkeypatch):
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="shared?|share"):
        scratch.path(Session())


def test_database_scan_pushes_its_predicate(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [(1, "x" * 300), (2, "short"), (3, None)]
    spark.createDataFrame(rows, "id int, description string").write.format("jdbc").options(url=url, dbtable="jobs", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    got = io.read_database(spark, url, "jobs", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").select("id", F.length("description").alias("n"))
    assert [(r.id, r.n) for r in got.collect()] == [(1, 300)]
