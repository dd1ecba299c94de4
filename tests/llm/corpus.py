"""Small texts for the tests: invented prose with copies, near copies, shared passages and odd rows."""

import random

DOCS = "doc_id long, text string, key string, id string, bucket int, row string, score double, n long"


def words(rng, n, vocabulary=400):
    return ["".join(rng.choice("aeioustrnl") for _ in range(2 + i % 7)) + (".", "", "", ",")[i % 4] for i in (rng.randrange(vocabulary) for _ in range(n))]


def texts(seed=1, n=40):
    rng = random.Random(seed)
    base = [" ".join(words(rng, rng.choice((3, 8, 60, 150, 400)))) for _ in range(n)]
    passage = " ".join(words(rng, 90))
    out = list(base)
    out += base[:6] + base[:3]  # exact copies
    for text in base:
        cut = text.split(" ")
        if len(cut) > 50:
            cut[rng.randrange(len(cut))] = "edited"
            out.append(" ".join(cut))
            cut[len(cut) // 2 : len(cut) // 2] = ["some", "added", "words"]
            out.append(" ".join(cut))
            out.append(text[:50] + " " + passage + " " + text[-40:])
    return out


def edge_texts():
    return [None, "", " ", "one", "a b", "Ä ö é 漢字 😀", "x" * 5000, "same " * 3000, "\n\t \x1c\x85", "THE!! ''S 's don't 123 <|endoftext|>"]


def documents(spark, given, ids=None):
    """Documents with further columns whose names operators use themselves."""
    ids = range(len(given)) if ids is None else ids
    rows = [(i, t, "k", "i", None, "r", 0.5, 3) for i, t in zip(ids, given)]
    return spark.createDataFrame(rows, DOCS)
