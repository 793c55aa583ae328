"""The filter audit against a count of every order by hand, with ids that arrive in any order."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from loomwork.llm import audit, queries
from loomwork.llm.common import shared_path

LABELS = "doc_id long, quality int, toxic int, note string"


def failed(docs):
    """The letters that each of (doc_id, text, lang) fails."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, _ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        out.append({k for k, v in bad.items() if v})
    return out


def plain(docs, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    out, fails = Counter(), failed(docs)
    for (i, _, lang), bad in zip(docs, fails, strict=True):
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                key = (lang or "", "".join(order), step)
                out[key, "kept"] += not gone and f not in bad
                out[key, "removed"] += not gone and f in bad
                out[key, "redundant"] += gone and f in bad
                out[key, "unique_fails"] += bad == {f}
                out[key, "good_lost"] += not gone and f in bad and i in good
                out[key, "toxic_lost"] += not gone and f in bad and i in toxic
                if not gone and f in bad:
                    out[lang or "", f, "shapley"] += 1
                gone = gone or f in bad
    return out


def check(spark, files, labels, per):
    """files of rows (doc_id, text, lang), streamed so many at a time."""
    path = shared_path(spark, "docs")
    for rows in files:
        spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, mask int, part string").coalesce(1).write.mode("append").parquet(path)
    got = audit.audit(spark, path, spark.createDataFrame([(*r, "") for r in labels], LABELS), per).collect()
    docs = [r for rows in files for r in rows]
    want = plain(docs, labels)
    assert len(got) == 600 * len({lang or "" for _, _, lang in docs})
    for r in got:
        key = (r["part"], r["filter_order"], r["step"])
        for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[c] == want[key, c], (key, c)
        assert r["shapley"] == want[r["part"], r["filter_order"][r["step"] - 1], "shapley"]


BASE = " ".join(f"w{i}" for i in range(120))
TEXTS = [BASE, BASE.upper(), BASE + " #", "a b c", "", " ".join(["x"] * 150), "É" * 10 + "A", "A B | B", BASE + " x", "x y " * 60]


@pytest.mark.parametrize("seed", range(2))
def test_smaller_ids_arrive_later(spark, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(2**53, 2**53 + 400), 90)
    docs = [(i, rng.choice(TEXTS), rng.choice(["en", "de", None])) for i in ids]
    docs.sort(key=lambda r: -r[0] if seed else rng.random())
    files = [docs[k::5] if not seed else docs[18 * k : 18 * k + 18] for k in range(5)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in ids[:60]] + [(ids[0], 1, 1), (None, 1, 1), (5, 1, 1)]
    check(spark, files, labels, 1)


def test_nulls_and_repeats(spark):
    rows = [(None, BASE, "en"), (None, None, None), (3, None, "en"), (2, "", None), (2, "", None), (2, "", "en"), (3, None, "en"), (-4, BASE, ""), (None, BASE, "en"), (-5, BASE, "en"), (2**62, BASE, "en")]
    check(spark, [rows[:5], rows[5:8], rows[8:]], [(2, 1, 0), (-5, 0, 1), (None, 1, 1)], 1)
    check(spark, [rows[6:], rows[:6]], [], 2)


def test_empty_table_and_unlabelled(spark):
    path = shared_path(spark, "none")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(path)
    assert audit.audit(spark, path, spark.createDataFrame([], LABELS)).count() == 0


def test_long_text_is_split_between_words():
    text = ("lorem ipsum dolor " * 200_000).encode()
    assert audit.text_mask(text, len(text)) == 0b0010
    assert audit.text_mask(b"x" * 3_000_000, 3_000_000) == 0b0001


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.op13_audit(spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()['op13_audit']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
