from worktrail.llm.lines import line_dedup


def brute(rows):
    """Rows are visited in key order, nulls last; equal (key, text) rows are one document."""
    seen, first = {}, {}
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    for key, text in order:
        lines = text.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            win = tuple(lines[p : p + 3])
            if not "".join(win).strip(" \t\x0b\x0c\r"):
                continue
            if win in first:
                gone |= {p, p + 1, p + 2}
            first.setdefault(win, (key, p))
        seen[key, text] = len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return [(k, *(seen[k, t] if t is not None else (0, 0, None))) for k, t in rows]


def run(spark, rows):
    docs = spark.createDataFrame([(k, t, k, 0, "x") for k, t in rows], "doc_id long, text string, lines_seen long, pos int, hash string")
    out = line_dedup(docs)
    assert out.columns == ["doc_id", "text", "pos", "hash", "lines_seen", "lines_cut"]
    return sorted(map(tuple, out.select("doc_id", "lines_seen", "lines_cut", "text").collect()), key=str)


def test_edge_cases(spark):
    block = "a\nb\nc"
    rows = [(5, block), (1, "x\na\nb\nc\nd"), (2, "a\nb"), (3, "p\na\nb\nc\nd\nq"), (3, "p\na\nb\nc\nd\nq"), (4, None), (6, ""), (7, "\n\n\n"), (8, "z\n\n\n\n"),
            (9, "s\ns\ns\ns\ns"), (None, "n\na\nb\nc"), (10, "\n".join(map(str, range(5000)))), (11, "\n".join(map(str, range(4000, 6000)))), (12, "a\r\nb\r\nc")]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert run(spark, []) == []


def test_no_python_on_the_path(spark):
    plan = line_dedup(spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_random_passages(spark):
    import random

    rng = random.Random(3)
    rows = [(k, "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))) for k in range(200)]
    assert run(spark, rows) == sorted(brute(rows), key=str)
