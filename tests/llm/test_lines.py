"""Line dedup against a plain count."""

from souklens.llm import lines

LONG = "This line is long enough to be counted, Été no {}"


def plain(rows, least_chars, least_docs):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if doc is None or len(holders.get(key(x), ())) < least_docs or doc == max(holders[key(x)])]
        out.append((doc if doc is not None else -1, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def rows_of():
    rows = [(i, "\n".join(x for j in range(1, 12) if i % j == 0 for x in [LONG.format(j), f"short {j}", "\t " + LONG.format(j).upper() + " \r"])) for i in range(300)]
    rows += [(None, LONG.format(1)), (None, None), (500, None), (501, ""), (502, "\n\n"), (7, LONG.format(1) + "\n" + LONG.format(3)), (7, LONG.format(1) + "\n" + LONG.format(3)),
             (503, "y" * 300_000 + "\n" + LONG.format(1)), (299, LONG.format(2))]
    return rows


def result(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect())


def test_equals_plain_count(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(lines.apply_bitmaps(df, lines.keep_bitmaps(df), keep=["doc_id"])) == plain(rows, 40, 5)
    spark.conf.set("spark.sql.shuffle.partitions", "60")  # hashes reach over many partitions
    try:
        assert result(lines.apply_bitmaps(df, lines.keep_bitmaps(df, least_chars=5, least_docs=3), keep=["doc_id"])) == plain(rows, 5, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_columns_stay(spark):
    df = spark.createDataFrame([(i, LONG.format(1), "k", i) for i in range(6)] + [(9, None, None, 9)], "doc_id long, text string, bitmap string, n_lines int")
    cut = lines.dedupe(df)
    assert cut.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["n_lines"]) for r in cut.collect() if r["doc_id"] < 9) == [(i, "" if i < 5 else LONG.format(1), i) for i in range(6)]
    assert cut.where("doc_id = 9").first()["text"] is None
    assert lines.dedupe(df.limit(0)).collect() == []
