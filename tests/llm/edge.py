"""Small tables with nulls, empty and long texts, ties, repeated rows and columns of names that operators use inside."""

WORDS = "the and of thing erand shonti edble onanre lyther ouwhst inge tionre hath erly ened thora".split()

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, spans string, h long, place int"


def prose(k, n=60):
    return " ".join(WORDS[(k * 7 + i * i * 3 + i * (k + 1)) % len(WORDS)] + chr(97 + (i * k) % 26) for i in range(n)) + "."


def documents(spark):
    texts = [
        (0, prose(0)), (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, prose(0)), (6, prose(0) + " more"), (7, prose(7, 6000)), (8, "\n".join([prose(8, 30), prose(9, 30), prose(8, 30)])),
        (9, "Élan vital, où ça? ß İ\x00　end."), (10, "1234 !!! ???"), (10, "1234 !!! ???"), (None, prose(0)), (None, None), (11, prose(11)), (11, prose(12)), (12, prose(12)),
        (13, "a b " * 2000), (14, prose(8, 30) + "\n" + prose(14, 30)),
    ]
    sources = ["s0", "s0", None, "s1", "S2", "é", "s0"]
    rows = [(i, t, ["en", "fr", None][k % 3], sources[k % len(sources)], len(t or ""), k, "d", "s", k, k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
