import hashlib
import re

from loomwork.llm import decontaminate as dc

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench):
    out = []
    for d, text in docs:
        w = words(text)
        hit, items = set(), set()
        for i, b in bench:
            v = words(b)
            for s in range(max(1, len(v) - 9) if v else 0):
                x = v[s : s + 10]
                for p in range(len(w) - len(x) + 1):
                    if w[p : p + len(x)] == x:
                        hit |= set(range(p, p + len(x)))
                        if i is not None:
                            items.add(str(i))
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(items), sha, bool(hit)))
    return sorted(out, key=str)


def run(spark, tmp_path, docs, bench):
    spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, words string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(a, b, 1) for a, b in bench], "item_id long, text string, win int").write.parquet(f"{tmp_path}/benchmark.parquet")
    return sorted(map(tuple, dc.op4_benchmark_decontamination(spark, str(tmp_path)).collect()), key=str)


def test_against_brute_force(spark, tmp_path):
    text = "Alpha beta, GAMMA delta-epsilon zeta eta theta iota kappa lambda mu été naïve x9"
    long = "the " * 30_000
    docs = [
        (1, text), (2, "zz " + text.lower() + " zz " + text), (3, None), (4, ""), (5, "alpha beta"), (None, "one"),
        (6, long), (7, "mu nu alpha beta gamma delta epsilon zeta eta theta iota"), (8, "--- !!"), (1, text),
        (9, "two words two words two"), (10, "a b c a b c a b c a b c a b c"),
    ]
    bench = [
        (0, text), (10, "One!"), (2, "two words"), (3, None), (4, " "), (5, "the " * 12), (6, "a b c a b c a b c a b"),
        (None, "beta gamma delta"), (0, text), (7, "never seen words here"),
    ]
    assert run(spark, tmp_path, docs, bench) == brute(docs, bench)


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path / "a", [], [(1, "x y z")]) == []
    assert run(spark, tmp_path / "b", [(1, "x y z")], []) == brute([(1, "x y z")], [])


def test_filter_keeps_columns_and_clean_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d", 1), (2, "q r s", 2), (None, None, None), (2, "q r s", 2)], "doc_id long, text string, rid long")
    bench = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    out = dc.drop_contaminated(docs, bench)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.where("doc_id is null or doc_id = 2").collect()))


def test_native_plan(spark):
    plan = dc.op4_benchmark_decontamination(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
