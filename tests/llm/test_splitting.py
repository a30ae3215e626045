import random
import re

from pyspark.sql import functions as F

from tamarack.llm import splitting as S


def classify(t, limit):
    fits = lambda parts: all(len(x.strip()) <= limit for x in parts)
    lines = t.split("\n")
    if fits(re.split(r"\n(?:[ \t\r]*\n)+", t)):
        return "paragraph"
    if fits(lines):
        return "line"
    if fits([s for x in lines for s in re.split(r"(?<=[.!?…])\s+", x)]):
        return "sentence"
    return "word" if fits(t.split()) else "character"


def texts():
    r = random.Random(4)
    out = []
    for _ in range(150):
        words = ["".join(r.choice("abcé…") for _ in range(r.choice([2, 3, 5, 9, 40]))) for _ in range(r.randint(5, 60))]
        out.append("".join(w + r.choice([" ", " ", " ", ". ", "\n", "\r\n", "\n \t\n", "! "]) for w in words))
    return [*out, "x" * 95, "é😀" * 50, "   \n ", "", None, "short", "a " * 15 + "\n\n" + "b" * 30]


def test_boundary_and_pieces(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "page_id long, text string")
    got = {r.page_id: r.b for r in df.select("page_id", S.weakest_boundary(F.col("text"), 30).alias("b")).collect()}
    for k, t in enumerate(texts()):
        if t and t.strip() and len(t) > 30:
            assert got[k] == classify(t, 30), t
    pieces = {}
    for r in S.split_oversized(df, "text", 30, 8).orderBy("page_id", "piece_no").collect():
        pieces.setdefault(r.page_id, []).append(r)
    for k, t in enumerate(texts()):
        if not t or not t.strip():
            assert k not in pieces
            continue
        assert [p.piece_no for p in pieces[k]] == list(range(1, len(pieces[k]) + 1))
        assert all(len(p.piece) <= 30 and p.overlap_chars <= 8 and p.piece in t for p in pieces[k])
        own = "".join(p.piece[p.overlap_chars :] for p in pieces[k])
        assert re.sub(r"\s", "", own) == re.sub(r"\s", "", t)
        if len(t) <= 30:
            assert [p.piece for p in pieces[k]] == [t]


def test_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "x", 7)], "page_id long, text string, piece string, piece_no int")
    assert S.split_oversized(df).columns == ["page_id", "piece_no", "boundary", "overlap_chars", "piece"]
    assert S.split_oversized(df.limit(0)).count() == 0


def test_overlap_repeats_the_end_of_the_piece_before(spark):
    """Exceptions: a unit that fits but leaves no room stays whole, and a short piece before is repeated whole."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 11)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    data = [
        " ".join(word() for _ in range(3000)),  # words only
        " ".join(sentence(r.randint(3, 25)) for _ in range(200)),
        "\n".join(sentence(r.randint(3, 25)) for _ in range(200)),
        "\n\n".join(" ".join(sentence(9) for _ in range(r.randint(1, 12))) for _ in range(60)),
        "x" * 9000,
        "\n\n".join("y" * 1900 for _ in range(4)),
    ]
    df = spark.createDataFrame(list(enumerate(data)), "page_id long, text string")
    pieces, exceptions = {}, {k: 0 for k in range(len(data))}
    for p in S.split_oversized(df).orderBy("page_id", "piece_no").collect():
        pieces.setdefault(p.page_id, []).append(p)
    for k, rows in pieces.items():
        own = [p.piece[p.overlap_chars :].strip() for p in rows]
        for n in range(1, len(rows)):
            assert len(rows[n].piece) <= 2000 and rows[n].overlap_chars <= 200
            assert rows[n - 1].piece.endswith(rows[n].piece[: rows[n].overlap_chars])
            if len(own[n]) > 1800 or len(own[n - 1]) < 200:
                exceptions[k] += 1
            else:
                assert rows[n].overlap_chars >= 185, (k, n)
    assert max(exceptions[k] for k in range(5)) <= 2, exceptions
    assert exceptions[5] == 3 and all(p.piece[p.overlap_chars :].strip() == "y" * 1900 for p in pieces[5])


def test_a_unit_that_fits_stays_whole(spark):
    t = "\n\n".join(["a" * 50 + " b" * 400, "c " * 960 + "d", "e f."])
    rows = S.split_oversized(spark.createDataFrame([(1, t)], "page_id long, text string")).orderBy("piece_no").collect()
    assert [r.boundary for r in rows] == ["paragraph"] * 3 and rows[1].piece.endswith("c " * 960 + "d")
