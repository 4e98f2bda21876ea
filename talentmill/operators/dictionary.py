"""Dictionary matching as a join: entries are rows of a table, so that a plan stays the same for ten entries or a million.

A text is cut into pieces, runs of word characters and single others, and its distinct runs of as many pieces as some entry
has become rows, which meet the entries by equality. An entry that begins or ends with a word character so matches whole words only;
at other ends the character outside must not be one of a word. Entries within a counted bound are broadcast, so that rows without a hit
never leave their task; hits alone are grouped. Substrings that may begin inside words meet the entries by their first three characters, and
by all of those that are shorter.

Nulls and empty texts have no hits; entries that are null or blank are left out; of equal entries the least rank counts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentmill.operators.skills import small

#: Entries, and characters of all of them, up to which a dictionary is sent to the tasks.
SENT_ROWS, SENT_CHARACTERS = 100_000, 4 << 20

#: Word characters of skills, and of titles.
SKILL_WORD, TITLE_WORD = r"A-Za-z0-9_+#.\-", "a-zа-яё0-9"


def pieces(text: Column, word: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)[{word}]+|[^{word}]"), F.lit(0))


def entries(dictionary: DataFrame, word: str, phrase: str = "phrase", label: str = "label", rank: str = "rank") -> DataFrame:
    """(phrase, label, rank, n, open_start, open_end): number of pieces, and whether an end is no word character."""
    rows = dictionary.select(F.col(phrase).alias("phrase"), F.col(label).alias("label"), F.col(rank).cast("long").alias("rank")).where(F.trim("phrase") != "")
    cut = rows.withColumn("_p", pieces(F.col("phrase"), word))
    return cut.select("phrase", "label", "rank", F.size("_p").alias("n"), (~F.col("phrase").rlike(f"^[{word}]")).alias("open_start"), (~F.col("phrase").rlike(f"[{word}]$")).alias("open_end"))


def ranked(df_rows: DataFrame, phrase: str, order: list[Column]) -> DataFrame:
    """Entries of a table numbered by an order, the label being the phrase itself. Meant for dictionaries: the numbering is one task's work."""
    return df_rows.select(F.col(phrase).alias("phrase"), F.col(phrase).alias("label"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


def with_hyphens(dictionary: DataFrame) -> DataFrame:
    """Entries also with blanks in place of all their hyphens, where they have some; mixed spellings are entries of their own."""
    return dictionary.unionByName(dictionary.where(F.contains("phrase", F.lit("-"))).withColumn("phrase", F.translate("phrase", "-", " ")))


def hits(df: DataFrame, key: str, text: Column, dictionary: DataFrame, word: str = SKILL_WORD) -> DataFrame:
    """(key, phrase, label, rank): entries that stand in ``text``, once a row and entry.

    ``dictionary``: what ``entries`` gives. Within SENT_ROWS and SENT_CHARACTERS it is sent to the tasks, which cut a text into pieces once and go on
    only where a piece begins an entry. For a larger one its shapes (length in pieces, and which ends are open), some tens at most, are asked before;
    each is one scan of a text, whose distinct runs of pieces meet the entries."""
    size = dictionary.limit(SENT_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(F.length("phrase")), F.lit(0))).first()
    if size[0] <= SENT_ROWS and size[1] <= SENT_CHARACTERS:
        return sent_hits(df, key, text, dictionary, word)
    shapes = dictionary.select("n", "open_start", "open_end").distinct().orderBy("n", "open_start", "open_end").collect()
    inside, outside = f"[{word}]", f"[^{word}]"

    def runs(n: int, open_start: bool, open_end: bool) -> Column:
        """Runs of ``n`` pieces with such ends; a match goes on by one piece, a run looks ahead."""
        start, end = (f"(?!{inside})" if open_start else ""), (f"(?<={outside})(?!{inside})" if open_end else f"(?<={inside})")
        run = f"(?:{inside}++|{outside}){{{n}}}"
        return F.regexp_extract_all(F.col("_text"), F.lit(f"(?s)(?<!{inside}){start}(?=({run}){end})(?:{inside}++|{outside})"), F.lit(1))

    grams = F.array_distinct(F.concat(*(runs(*shape) for shape in shapes)))
    each = df.select(key, F.coalesce(text, F.lit("")).alias("_text")).select(key, F.explode(grams).alias("_gram"))
    return each.join(small(dictionary), F.col("_gram") == F.col("phrase")).select(key, "phrase", "label", "rank")


def sent_hits(df: DataFrame, key: str, text: Column, dictionary: DataFrame, word: str) -> DataFrame:
    """What ``hits`` gives, for a dictionary of bounded size that is sent to the tasks."""
    rows = dictionary.select("phrase", "label", "rank").collect()  # at most SENT_ROWS
    types = {c: t.simpleString() for c, t in ((f.name, f.dataType) for f in dictionary.schema) if c in ("phrase", "label", "rank")}
    cut = re.compile(f"[{word}]+|[^{word}]", re.S)
    tree, entry = {}, {}  # pieces in order, None where a phrase ends; phrase: its rows
    for i, r in enumerate(rows):
        node = tree
        for piece in cut.findall(r["phrase"]):
            node = node.setdefault(piece, {})
        node[None] = r["phrase"]
        entry.setdefault(r["phrase"], []).append(i)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word = lru_cache(1 << 16)(lambda piece: re.match(f"[{word}]", piece) is not None)
        for b in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            place, what = [], []
            for row, t in enumerate(b.column(1)):
                got, parts = set(), cut.findall(t.as_py())
                total = len(parts)
                for i, p in enumerate(parts):
                    node = tree.get(p)
                    if node is None or i and is_word(parts[i - 1]) and not is_word(p):
                        continue
                    j = i + 1
                    while node is not None:
                        if None in node and (j == total or is_word(parts[j - 1]) or not is_word(parts[j])):
                            got.add(node[None])
                        node = node.get(parts[j]) if j < total else None
                        j += 1
                for phrase in got:
                    place += [row] * len(entry[phrase])
                    what += entry[phrase]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place, pa.int64())), pa.array(what, pa.int32())], names=[key, "_at"])

    at = df.select(key, F.coalesce(text, F.lit("")).alias("_text")).mapInArrow(find, f"`{key}` {dict(df.dtypes)[key]}, _at int")
    table = df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_at int, " + ", ".join(f"{c} {types[c]}" for c in ("phrase", "label", "rank")))
    return at.join(F.broadcast(table), "_at").select(key, "phrase", "label", "rank")


def substring_hits(df: DataFrame, key: str, text: Column, dictionary: DataFrame) -> DataFrame:
    """(key, phrase, label, rank): entries that stand anywhere in ``text``, also inside words, once a row and entry.

    Each distinct stretch as long as the longest entry gives its first three characters (one or two for entries that short)."""
    rows = dictionary.select("phrase", "label", "rank", F.length("phrase").alias("_n"), F.left("phrase", F.lit(3)).alias("_head"))
    longest, heads = rows.agg(F.max("_n"), F.array_sort(F.collect_set(F.least("_n", F.lit(3))))).first()
    if longest is None:
        return df.select(key).limit(0).join(rows.select("phrase", "label", "rank"))  # no entries: no rows
    stretches = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{longest}}}))."), F.lit(1)))
    each = df.select(key, F.explode(stretches).alias("_s")).select(key, "_s", F.explode(F.array(*(F.left("_s", F.lit(h)) for h in heads))).alias("_head"))
    return each.join(small(rows), "_head").where(F.startswith("_s", "phrase")).select(key, "phrase", "label", "rank").distinct()


def labels(df: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """(key, labels): sorted distinct labels of every row of ``df`` by its unique ``key``, empty where there was no hit."""
    both = df.select(key, F.lit(None).cast("string").alias("label")).unionByName(found.select(key, "label"))
    return both.groupBy(key).agg(F.array_sort(F.collect_set("label")).alias("labels"))


def first_label(df: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """(key, label): of each row's hits the one of least rank; null where there was none."""
    at = found.select(key, F.struct("rank", "label").alias("_hit"))
    both = df.select(key, F.lit(None).cast(at.schema["_hit"].dataType).alias("_hit")).unionByName(at)
    return both.groupBy(key).agg(F.min("_hit").alias("_hit")).select(key, F.col("_hit.label").alias("label"))


def longest_first(dictionary: DataFrame) -> list[Column]:
    """Order by which the longest entry of a title comes first, then the one that was given first."""
    return [F.desc(F.length("phrase")), F.col("rank")]


def specialties(df: DataFrame, key: str, title: Column, dictionary: DataFrame) -> DataFrame:
    """(key, label): the longest phrase of ``dictionary`` (phrase, rank; any number of rows) that stands in a title as whole words."""
    from talentmill.functions.text import norm_query

    order = Window.orderBy(*longest_first(dictionary))
    numbered = dictionary.select(F.lower("phrase").alias("phrase"), F.col("phrase").alias("label"), F.row_number().over(order).alias("rank"))
    spelled = with_hyphens(numbered).groupBy("phrase").agg(F.min_by("label", "rank").alias("label"), F.min("rank").alias("rank"))
    return first_label(df, key, hits(df, key, norm_query(title), entries(spelled, TITLE_WORD), TITLE_WORD))


def skills_of(df: DataFrame, key: str, text: Column, dictionary: DataFrame) -> DataFrame:
    """(key, labels): skills of ``dictionary`` (phrase) that stand in a text, as ``functions.text.extract_skills`` finds them."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")
    words = dictionary.select(F.col("phrase"), F.col("phrase").alias("label"), F.lit(0).alias("rank")).distinct()
    return labels(df, key, hits(df, key, flat, entries(words, SKILL_WORD)))
