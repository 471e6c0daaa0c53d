"""The source audit against a plain loop; tests/llm/test_sql.py holds it against SQL."""

import re
from collections import Counter, defaultdict

from corpuslab.llm import divergence
from corpuslab.llm.queries import oracle_sql, queries
from tests.compare import assert_same
from tests.llm.tables import documents, write

TERM = re.compile(divergence.TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in ((t or "", g or "", s or "") for t, g, s in rows):
        words = TERM.findall(text.translate(LOWER))
        groups[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    share = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
    ranked = lambda found: enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1)
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        p = {s: {t: share(c[t], sum(c.values()), len(kept)) for t in kept} for s, c in own.items()}
        q = {t: share(whole[t], sum(whole.values()), len(kept)) for t in kept}
        for s in own:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", item, v, r) for r, (item, v) in ranked(pairs)}
            out |= {(lang, s, "term", item, v, r) for r, (item, v) in ranked(terms) if r <= top}
    return out


ROWS = [
    *[(f"The naïve ÉTÉ w{chr(97 + i % 7)} x{'y' * (i % 5)} the", ("en", "fr", None)[i % 3], ("a", "b", "é", None)[i % 4]) for i in range(120)],
    *[("The the THE odd", "en", "a")] * 20,  # repeated rows
    (None, "en", "no terms"), ("", "de", "x"), ("12 34", "de", "y"), ("Ünicode only", "de", "z"), (None, None, None),
    ("long " * 30_000 + "ende", "en", "b"), ("A_B@c[d`e{f", "en", "é"), ("a\x00b\x7fc", "en", "é"),
]


def table(spark):
    return spark.createDataFrame([(i, t, g, s, 0) for i, (t, g, s) in enumerate(ROWS)], documents(spark, []).schema)


def test_plain_loop(spark):
    for least, top in ((1, 3), (5, 50), (10_000, 50)):
        got = divergence.audit(table(spark), least=least, top=top).collect()
        assert {tuple(r) for r in got} == plain(ROWS, least, top)
        assert len(got) == len(plain(ROWS, least, top))


def test_odd_rows_by_sql(spark, tmp_path):
    import duckdb

    write(table(spark), tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(queries()["op12_source_divergence"](spark, str(tmp_path)), con, oracle_sql()["op12_source_divergence"])


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    count, total, kept = 7 * 10**15, 9 * 10**15, 10**6
    got = spark.range(1).select(divergence.share(F.lit(count), F.lit(total), F.lit(kept)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (count + 5) // (total + 5 * kept)
