"""A2/A5: types of all files by one job, against Spark's own inference file by file."""

import pytest

from tillpoint.sources import csv as C

FILES = {
    "ints.csv": "a,b,c\n1,2147483648,99999999999999999999\n-5,+7,1\n,,\n",
    "mixed.csv": "id,Amount ,when,day,flag,text\n1,1.5,2024-01-02 03:04:05,2024-01-02,true,x\n2,7,2024-01-02,2024-02-03,FALSE,1\n3,1e3,,,,\n",
    "quoted.csv": '"a,1","b ""q""",c\n"x, y",2,"3"\n"","4",5\n',
    "short.csv": "a,b,c\n1\n2,3\n4,5,6,7\n",
    "blank.csv": "\n\na,b\n\n1,2\n   \n3,x\n",
    "names.csv": "a,,A,b\n1,2,3,4\n",
    "header.csv": "a,b\n",
    "spaces.csv": "a,b\n 1,2\n3, 4\n",
    "reals.csv": "a,b,c\n1.0,.5,NaN\n2,3,1\n",
    "years.csv": "2020,2021\n1.5,x\n",
    "crlf.csv": "a,b\r\n1,2\r\n3,4.5\r\n",
}


@pytest.fixture()
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_bytes(text.encode())
    return tmp_path


def test_schemas_equal_inference_by_file(spark, folder):
    paths = [str(folder / n) for n in FILES]
    got = C.infer_schemas(spark, paths)
    for p in paths:
        want = spark.read.options(**C.CSV_OPTIONS).option("inferSchema", True).csv(p).schema
        assert got[p].simpleString() == want.simpleString().replace("timestamp_ntz", "timestamp"), p
        rows = lambda s: [tuple(r) for r in spark.read.options(**C.CSV_OPTIONS).schema(s).csv(p).collect()]
        assert str(rows(got[p])) == str(rows(want)), p


def test_one_job_for_any_number_of_files(spark, tmp_path):
    def jobs(n):
        paths = []
        for i in range(n):
            (tmp_path / f"{n}-{i}.csv").write_text(f"a,b{i}\n{i},x\n1.5,2\n")
            paths.append(str(tmp_path / f"{n}-{i}.csv"))
        group = f"types-{n}"
        spark.sparkContext.setJobGroup(group, "")
        frames = C.read_csv_files(spark, paths)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert [f.schema.simpleString() for f in frames.values()] == [f"struct<a:double,b{i}:string>" for i in range(n)]
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(2) == jobs(25) <= 8         # stages of the two aggregates, as adaptive plans run them


def test_failing_files_encodings_and_empty_ones(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("näme,n\nü,1\n".encode("latin-1"))
    (tmp_path / "utf.csv").write_bytes("näme,n\nü,1\n".encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    paths = [str(tmp_path / n) for n in ("latin.csv", "utf.csv", "empty.csv", "gone.csv")]
    frames = C.read_csv_files(spark, paths)
    for p in paths[:2]:
        assert frames[p].schema.simpleString() == "struct<näme:string,n:int>" and frames[p].first()["näme"] == "ü"
    assert frames[paths[2]].columns == [] and isinstance(frames[paths[3]], FileNotFoundError)
    assert C.infer_schemas(spark, []) == {} and C.read_csv_files(spark, []) == {}


def test_large_file_in_many_splits(spark, tmp_path):
    """The header is the first line of the first split only."""
    with open(tmp_path / "big.csv", "w") as f:
        f.write("k,v\n" + "".join(f"{i},{i}.5\n" for i in range(60000)) + "x,1\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        assert C.infer_schemas(spark, [str(tmp_path / "big.csv")])[str(tmp_path / "big.csv")].simpleString() == "struct<k:string,v:double>"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
