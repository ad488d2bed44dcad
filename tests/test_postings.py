"""Names found through the kept gram index against brute force."""

import random
import re

from faultweave.operators import postings
from faultweave.operators import tickets as ticket_ops

SCHEMA = "seq long, summary string, description string, labels string"


def texts(seed, n):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choices("abcdé😀_ \n", k=pick.randint(0, 12)))
    return [(i, word(), pick.choice([None, word()]), word()) for i in range(n)]


def brute(names, rows):
    return sorted((name, r[0]) for name in names for r in rows if any(name in (t or "") for t in r[1:]))


def pairs(spark, names, path):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    return sorted(map(tuple, postings.posted_pairs(df, path).collect()))


def test_equals_brute_force_over_generations(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "PART_ROWS", 7)  # long posting lists are cut
    rows, path = texts(1, 200), f"{tmp_path}/postings"
    postings.write_postings(spark.createDataFrame(rows[:150], SCHEMA), path)
    for _ in range(2):
        postings.write_postings(spark.createDataFrame(rows[150:], SCHEMA), path, 1)
    pick = random.Random(2)
    names = {"".join(pick.choices("abcdé😀_ \n", k=pick.randint(1, 5))) for _ in range(120)} | {"zz", "not there", "😀", "a\nb"}
    names |= {t[1][1:6] for t in rows[::9] if len(t[1]) > 3}
    assert pairs(spark, names, path) == brute(names, rows)


def test_rarest_gram_bounds_the_candidates(spark, tmp_path):
    rows = [(i, f"job common_{i:03d}", "", "") for i in range(200)]
    path = f"{tmp_path}/postings"
    postings.write_postings(spark.createDataFrame(rows, SCHEMA), path)
    names = spark.createDataFrame([("common_017",), ("absent_017",), ("common",)], "name string")
    found = {r.name: (r.gram, r.n) for r in postings.rarest_grams(names, path).collect()}
    assert found["common_017"][1] <= 3 and found["common"][1] == 200 and "absent_017" not in found


def test_names_stay_in_spark_and_few_folders_are_read(spark, tmp_path):
    rows = [(i, f"word{i:04d}", None, "") for i in range(500)]
    path = f"{tmp_path}/postings"
    postings.write_postings(spark.createDataFrame(rows, SCHEMA), path, buckets=64)
    names = spark.createDataFrame([("word0123",)], "name string")
    chosen = postings.rarest_grams(names, path, 64).withColumn("bucket", postings._bucket(postings.F.col("gram"), 64))
    numbers = postings._numbers(chosen)
    assert len(numbers) == 1
    lists = postings._read(spark, path, "postings", "gram string, seq long").where(postings.F.col("bucket").isin(numbers))
    assert re.search(r"PartitionFilters: \[.*bucket", lists._jdf.queryExecution().executedPlan().toString())


def test_nothing_indexed(spark, tmp_path):
    assert pairs(spark, ["a"], f"{tmp_path}/none") == []
    asked = spark.createDataFrame([("",), (None,)], "job_name string")
    postings.write_postings(spark.createDataFrame([], SCHEMA), f"{tmp_path}/empty")
    assert ticket_ops.posted_ticket_matches(asked, f"{tmp_path}/empty").count() == 0
    assert pairs(spark, ["a"], f"{tmp_path}/empty") == []


def test_a_text_is_read_once_for_all_its_names(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"word{n:02d}" for n in range(40)), "", None) for i in range(30)]
    path, written = f"{tmp_path}/postings", {}

    def noted(df, name="table", keep=postings.materialise):
        written[name] = keep(df, name)
        return written[name]

    monkeypatch.setattr(postings, "materialise", noted)
    postings.write_postings(spark.createDataFrame(rows, SCHEMA), path)
    names = [f"word{n:02d}" for n in range(50)]
    assert pairs(spark, names, path) == brute(names, rows)
    assert written["candidates"].count() == 30
    # a gram's texts come in lists, not as a row each
    kept = spark.read.parquet(f"{path}/postings")
    assert kept.count() == written["gram-lists"].count() < 30 * kept.select("gram").distinct().count() / 5


def test_long_texts_and_slices_that_are_halved(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SLICE_CHARS", 50)
    monkeypatch.setattr(postings, "NAMES_AT_A_TIME", 5)
    monkeypatch.setattr(postings, "TEXTS_AT_A_TIME", 3)
    rows, path = texts(7, 60) + [(60, "abc" * 40, "d", "é😀" * 30)], f"{tmp_path}/postings"
    postings.write_postings(spark.createDataFrame(rows + [(None, "abc", "", "")], SCHEMA), path)
    names = {t[1][i : i + n] for t in rows for i, n in ((0, 2), (1, 4), (2, 1)) if len(t[1]) >= 6}
    assert pairs(spark, names, path) == brute(names, rows)


def test_lists_are_packed(spark, tmp_path, monkeypatch):
    """One value per list, as narrow as its slice allows; numbers of any size, short texts and cut slices."""
    rows = [(seq, word, None, word[:1]) for seq, word in zip([5, -3, 2**62, 7, 70000, -(2**63), 9], ["abc", "ab", "a", "", "abab", "babc", "é😀"])]
    near = [(1000 + i, f"near {i % 3}", "", None) for i in range(200)]
    path = f"{tmp_path}/postings"
    monkeypatch.setattr(postings, "LISTED_AT_A_TIME", 3)
    postings.write_postings(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    postings.write_postings(spark.createDataFrame(near, SCHEMA).coalesce(1), path, 1)
    names = ["a", "b", "ab", "abc", "bab", "é", "é😀", "near", "r 2", "zz"]
    assert pairs(spark, names, path) == brute(names, rows + near)
    lists = spark.read.parquet(f"{path}/postings").where("generation = 1")
    assert dict(lists.dtypes)["held"] == "binary"
    assert {(r.n, len(r.held)) for r in lists.where("gram = 'nea'").collect()} == {(200, 200)}


def by_blocks(spark, names, rows):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    return sorted(map(tuple, postings.pairs_by_blocks(df, spark.createDataFrame(rows, SCHEMA)).collect()))


def test_blocks_equal_brute_force_and_a_kept_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SLICE_CHARS", 60)
    monkeypatch.setattr(postings, "BLOCK_NAME_CHARS", 20)  # the names of a block are asked for in parts
    rows = texts(3, 150) + [(150, "abc" * 40, "d", "é😀" * 30), (-(2**63), "zz top", None, None)]
    pick = random.Random(4)
    names = {"".join(pick.choices("abcdé😀_ \n", k=pick.randint(1, 5))) for _ in range(120)} | {"zz", "not there", "😀", "a\nb"}
    assert by_blocks(spark, names, rows + [(None, "abc", "", "")]) == brute(names, rows)
    # numbers that come more than once
    rows += rows[::5] + [(7, "abcd", "other", ""), (8, "", "", None)]
    path = f"{tmp_path}/postings"
    postings.write_postings(spark.createDataFrame(rows, SCHEMA), path)
    assert by_blocks(spark, names, rows) == pairs(spark, names, path)


def test_names_go_to_blocks_and_not_to_each_text(spark, monkeypatch):
    """What is written for many names follows texts and blocks, not names times texts."""
    words = [f"word{n:03d}" for n in range(300)]
    rows = [(i, " ".join(f"{w[:5]} {w[2:]}" for w in words), words[i % 300], None) for i in range(400)]
    written = {}

    def noted(df, name="table", keep=postings.materialise):
        written[name] = keep(df, name)
        return written[name]

    monkeypatch.setattr(postings, "materialise", noted)
    asked = spark.createDataFrame([(w,) for w in words], "job_name string")
    tickets = spark.createDataFrame([(*r[:3], []) for r in rows], "seq long, summary string, description string, labels array<string>")
    found = ticket_ops.ticket_matches(asked, tickets.coalesce(1), name_chars=0).collect()
    assert sorted((r.name, r.seq) for r in found) == brute(words, rows)
    names = sum(df.select(postings.F.sum(postings.F.size("names"))).first()[0] for df in written.values() if "names" in df.columns)
    others = sum(df.count() for df in written.values())
    assert names + others < len(rows) * len(words) / 10
