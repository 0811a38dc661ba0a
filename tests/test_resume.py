import pytest
from pyspark.sql import functions as F

from sparkstrata.sources import extract, resume

FILES = "path string, content string"
ROWS = "file string, n int"


def test_a_stopped_build_goes_on(spark, tmp_path):
    files = spark.createDataFrame([(f"src/f{k}.ts", "x" * k) for k in range(60)] + [(None, "no path"), ("e", None)], FILES)
    made = spark.sparkContext.accumulator(0)
    calls = []

    def step(own):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt  # the build is killed
        made.add(own.count())
        return own.where("path <> 'e'").select(F.col("path").alias("file"), F.length("content").alias("n"))

    with pytest.raises(KeyboardInterrupt):
        resume.build_in_chunks(files, str(tmp_path), step, ROWS, 10, 2)
    first = made.value
    want = sorted((r.path or "", len(r.content)) for r in files.collect() if r.path != "e")
    assert 0 < first < 62
    assert sorted(map(tuple, resume.build_in_chunks(files, str(tmp_path), step, ROWS, 10, 2).collect())) == want
    assert made.value == 62  # only the open chunks were made
    assert sorted(map(tuple, resume.build_in_chunks(files, str(tmp_path), step, ROWS, 10, 2).collect())) == want
    assert made.value == 62
    changed = files.withColumn("content", F.when(F.col("path") == "src/f7.ts", "new").otherwise(F.col("content")))
    got = {r.file: r.n for r in resume.build_in_chunks(changed, str(tmp_path), step, ROWS, 10, 2).collect()}
    assert got["src/f7.ts"] == 3 and len(got) == 61 and 62 < made.value < 62 + 20  # one chunk anew
    assert resume.build_in_chunks(files.limit(0), str(tmp_path), step, ROWS).count() == 0


def test_extraction_in_chunks(spark, tmp_path):
    files = spark.createDataFrame([(f"f{k}.ts", f"export function f{k}() {{ g(); }}", "typescript") for k in range(20)], FILES + ", language string")
    out = resume.build_in_chunks(files, str(tmp_path), lambda own: extract.extract(own), extract.ROWS, 4, 4)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, extract.extract(files).collect()))
