"""A small corpus with the awkward rows every operator must take."""

import random

WORDS = [f"{a}{b}" for a in ("lor", "mip", "dol", "sit", "ame", "con", "sec", "tet") for b in ("em", "sum", "or", "ur", "is", "elit", "ado")]


def prose(seed: int, n: int = 120) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def rows() -> list[tuple]:
    out = [(i, prose(i), "en", "s0", 0, "x") for i in range(40)]
    base = prose(7, 300)
    out += [(100 + i, base, "en", "hot", 0, None) for i in range(12)]  # exact copies
    for i in range(12):  # near copies
        words = base.split()
        words[10 * i + 3] = f"changed{i}"
        out.append((200 + i, " ".join(words), None, "hot", None, "y"))
    out += [(300, None, "en", None, None, "z"), (301, "", "en", "s1", 0, "z"), (302, " ", "en", "s1", 1, "z"), (303, "\n\t  \n", "en", "s1", 1, "z"), (304, "one", "en", "s1", 3, "z"), (305, "One two", "en", "s1", 3, "z"), (306, "one TWO", "en", "s1", 3, "z")]
    out += [(307, "Ünïcödé  «ça»   va?\n\n\tHello <|endoftext|> wörld'll  🙂 12345  x\u00a0y İ Σ\x1c.", "fr", "s1", 3, "z")]
    out += [(308, prose(1, 9000), "en", "long", 0, "z"), (309, "a" * 3000, "en", "long", 0, "z")]
    out += [(310, prose(3), "en", "s0", 0, "x"), (310, prose(3), "en", "s0", 0, "x"), (None, prose(4), "en", "s0", 0, "x"), (None, None, None, None, None, None)]  # repeated rows, null ids
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def corpus(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
