"""CSV corpora by column name, null words, and the four-file load order."""
import pytest

from glare.operators import prep
from glare.sources import files


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_columns_go_by_name(spark, tmp_path):
    p = write(tmp_path / "arms.csv", "created_at,clickability_test_id,excerpt,headline,impressions,clicks\n"
              '2014,t1,x,"A ""quoted"", headline",100,7\n2015,t2,,"two\nlines",NA,x\n')
    rows = files.read_csv(spark, p, files.ARMS_SCHEMA).collect()
    assert [tuple(r) for r in rows] == [("t1", 'A "quoted", headline', 100, 7), ("t2", "two\nlines", None, None)]


def test_missing_column_is_named(spark, tmp_path):
    p = write(tmp_path / "arms.csv", "clickability_test_id,impressions,clicks\nt1,1,2\n")
    with pytest.raises(ValueError, match="headline"):
        files.read_csv(spark, p, files.ARMS_SCHEMA)


def test_null_words_are_not_trimmed(spark, tmp_path):
    p = write(tmp_path / "c.csv", "id,title\n1,NA\n2,None\n3,\n4, NA \n5,null\n6,Nan\n7,nan\n")
    rows = {r.id: r.title for r in files.read_csv(spark, p).collect()}
    assert rows == {"1": None, "2": None, "3": None, "4": " NA ", "5": None, "6": "Nan", "7": None}


def test_labelled_corpus_keeps_the_first_title(spark, tmp_path):
    for k, (source, name) in enumerate([("s", "fake"), ("s", "real"), ("t", "fake"), ("t", "real")]):
        write(tmp_path / f"{source}_{name}.csv", f"tweet_ids,title,id,news_url,extra\n1\\t2,same,{k},u,z\n,own {k},{k + 10},,z\n")
    c = files.read_labelled_corpus(spark, str(tmp_path), ["s", "t"])
    assert c.count() == 8
    kept = {r.title: (r.id, r.source, r.fake) for r in prep.dedup_keep_first(c, "title", "ord").collect()}
    assert kept["same"] == ("0", "s", 1) and len(kept) == 5


def test_parquet_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, part string")
    files.write_table(df, str(tmp_path / "t"), ["part"])
    files.write_table(df, str(tmp_path / "t"), ["part"])
    assert {(r.id, r.part) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "a"), (2, "b")}
