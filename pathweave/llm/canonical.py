"""Problem 4: freely typed names mapped to the entry of a reference list that is meant, unmatched ones reported.

Method: prefix-filter set-similarity join. A name becomes a set of tokens; tokens are ordered by how rare they are among all typed names
and entries together, and only each set's rare prefix is joined: two sets of Jaccard similarity t or more share a token in their
prefixes. Length and positional filters drop most of the candidates, the Jaccard similarity of the others is computed exactly, and the
best entry is kept. An equal name is a similarity of 1, found by the same join.

The tokens of a name are its letters, numbered where they repeat, and the unordered pairs of letters at most two places apart, with a
mark at each end. Swapped neighbours keep their letters and most of these pairs, so typing errors of all kinds leave sets similar.

What people put around a name (articles, "database", version numbers) is learned from the data, not listed: a word is wrapping if it
is what is left over when entries' exact forms are found inside typed names, for more than a given share of all entries.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.runtime import Scratch, filled, heavy_keys, lookup, ship

#: An entry is meant if the Jaccard similarity is at least this.
SIMILAR = 0.47
#: A word is wrapping if it stands around the exact forms of more than this share of the entries, and of two at least.
WRAPPING = 0.1
#: A token with more than this many sets is joined in so many parts more.
HOT = 100_000

# Look-alike letters of other scripts and the Latin letters they stand for.
LOOK_ALIKE = str.maketrans(
    "аеорсухіјѕԁӏвкмнтгАВЕКМНОРСТХУІЈЅαοενρτυικχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıłøß",
    "aeopcyxijsdlbkmhtrabekmhopctxyijsaoevptuikxabezhikmnoptyxilos",
)


def words_of(name: str) -> list[str]:
    """The words of letters and digits in a name: compatibility forms and look-alikes folded, accents and case dropped."""
    s = unicodedata.normalize("NFKD", name).translate(LOOK_ALIKE)
    s = "".join(ch for ch in s if not unicodedata.combining(ch) and unicodedata.category(ch) != "Cf").casefold()
    return re.findall(r"[a-z0-9]+", s)


def tokens_of(name: str) -> list[str]:
    """The token set of a plain name: numbered letters, and unordered pairs of letters one or two places apart, ends marked."""
    seen: Counter[str] = Counter()
    out = set()
    for ch in name:
        seen[ch] += 1
        out.add(f"{ch}{seen[ch]}")
    marked = f"^{name}$"
    for apart in (1, 2):
        out.update(f"{min(p)}_{max(p)}" for p in zip(marked, marked[apart:], strict=False))
    return sorted(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def words_udf(names: pd.Series) -> pd.Series:
    return names.map(words_of, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens_udf(names: pd.Series) -> pd.Series:
    return names.map(tokens_of)


def set_similarity_join(left: DataFrame, right: DataFrame, threshold: float, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """(l, r, jaccard) of all l in left (l, s) and r in right (r, s) whose sets have Jaccard >= threshold, exactly.

    l and r are distinct strings, s arrays of distinct tokens; empty sets match nothing. Rarity is counted over both sides. A prefix is
    a set's n - ceil(t n) + 1 rarest tokens. A token of many sets is joined in parts: left rows go to one part each, right rows to all.
    Only names and positions are joined; the sets come back for the candidates that pass the filters.
    """
    words = left.select(F.col("l").alias("w"), F.lit(0).alias("side"), "s").unionByName(right.select(F.col("r").alias("w"), F.lit(1).alias("side"), "s"))
    tokens = scratch.write(words)[0].select("w", "side", F.explode("s").alias("t"))
    rarity, _ = scratch.write(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("f")))
    ranked = tokens.join(rarity, "t").groupBy("w", "side").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("s"))
    sets, _ = scratch.write(ranked.withColumn("n", F.size("s")))
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1
    prefix = sets.select("w", "side", "n", F.posexplode(F.slice("s", F.lit(1), keep.cast("int"))).alias("i", "ft")).select("w", "side", "n", "i", "ft.t", (F.col("ft.f") / hot).cast("int").alias("more"))
    a = prefix.filter("side = 0").select(F.col("w").alias("l"), F.col("n").alias("x"), F.col("i").alias("li"), "t", F.pmod(F.xxhash64("w"), F.col("more") + 1).cast("int").alias("part"))
    b = prefix.filter("side = 1").select(F.col("w").alias("r"), F.col("n").alias("y"), F.col("i").alias("ri"), "t", F.explode(F.sequence(F.lit(0), "more")).alias("part"))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("x") + F.col("y")) - 1e-9)
    lengths = (F.col("x") >= F.col("y") * F.lit(threshold) - 1e-9) & (F.col("y") >= F.col("x") * F.lit(threshold) - 1e-9)
    position = 1 + F.least(F.col("x") - F.col("li") - 1, F.col("y") - F.col("ri") - 1) >= need - F.least("li", "ri")
    shared = a.join(b, ["t", "part"]).filter(lengths & position).groupBy("l", "r", "x", "y").agg(F.count(F.lit(1)).alias("c"), F.max("li").alias("li"), F.max("ri").alias("ri"))
    # what both sets share: the tokens shared in their prefixes, and at most what is left of the shorter one behind the last of these
    found = shared.filter(F.col("c") + F.least(F.col("x") - F.col("li"), F.col("y") - F.col("ri")) - 1 >= need).select("l", "r")
    side = lambda k, name, s: sets.filter(F.col("side") == k).select(F.col("w").alias(name), F.transform("s", lambda x: x["t"]).alias(s))
    both = found.join(side(1, "r", "rs"), "r").join(side(0, "l", "ls"), "l")
    judged = both.select("l", "r", F.size("ls").alias("x"), F.size("rs").alias("y"), F.size(F.array_intersect("ls", "rs")).alias("common"))
    return judged.select("l", "r", (F.col("common") / (F.col("x") + F.col("y") - F.col("common"))).alias("jaccard")).filter(F.col("jaccard") >= threshold)


def entry_forms(registry: DataFrame) -> DataFrame:
    """(db_id, words): the words of every entry's name, full name and synonyms."""
    empty = F.array().cast("array<string>")
    forms = registry.select("db_id", F.explode(F.array_union(F.array("db_name", "full_name"), F.coalesce("synonyms", empty))).alias("form"))
    return forms.select("db_id", words_udf("form").alias("words")).filter("size(words) > 0").distinct()


def wrapping_words(typed: DataFrame, forms: DataFrame, share: float = WRAPPING) -> DataFrame:
    """(word): words that stand around exact forms of entries in typed names; numbers in words count as one.

    typed (words), distinct; forms (db_id, words). Every run of words in every typed name is compared with the entries' forms.
    """
    exact = forms.select(F.array_join("words", "").alias("form"), "db_id").groupBy("form").agg(F.min("db_id").alias("db_id"))
    widest = forms.agg(F.max(F.length(F.array_join("words", ""))).alias("widest"))  # one row; no run of more words than that is a form
    n = F.size("words")
    runs = typed.filter(n > 1).crossJoin(F.broadcast(widest)).withColumn("i", F.explode(F.sequence(F.lit(1), n)))
    runs = runs.withColumn("k", F.explode(F.sequence(F.lit(1), F.least("widest", n - F.col("i") + 1)))).filter(F.col("k") < n)
    around = F.concat(F.slice("words", F.lit(1), F.col("i") - 1), F.slice("words", F.col("i") + F.col("k"), n))
    hits = runs.select(F.array_join(F.slice("words", F.col("i"), F.col("k")), "").alias("form"), around.alias("around")).join(exact, "form")
    words = hits.select("db_id", F.explode("around").alias("w")).select("db_id", _numberless("w").alias("word")).distinct()
    entries = forms.select("db_id").distinct().agg(F.count(F.lit(1)).alias("entries"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(entries)).filter((F.col("n") > F.col("entries") * share) & (F.col("n") > 1)).select("word")


def _numberless(word: str):
    return F.regexp_replace(word, "[0-9]+", "0")


def unwrapped(rows: DataFrame, key: str, wrapping: DataFrame) -> DataFrame:
    """(key, core): the rows' words (key: distinct, words) without wrapping ones, joined; all of them where nothing else is left."""
    each = rows.select(key, F.posexplode("words").alias("i", "w")).withColumn("word", _numberless("w"))
    kept = each.join(wrapping, "word", "left_anti").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("kept"))
    core = F.coalesce(F.array_join(F.transform("kept", lambda x: x["w"]), ""), F.array_join("words", ""))
    return rows.join(kept, key, "left").select(key, core.alias("core"))


def match_names(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, db_id, score) for names (name: distinct, not blank): the entry of registry that is meant, -1 and 0 if none is.

    The highest Jaccard similarity decides; ties go to the least db_id, also where entries share a form.
    """
    ship(names.sparkSession)
    scratch = Scratch(names.sparkSession, "names")
    typed, _ = scratch.write(names.select("name", words_udf("name").alias("words")))
    forms, _ = scratch.write(entry_forms(registry).coalesce(1))
    wrapping, _ = scratch.write(wrapping_words(typed.select("words").distinct(), forms).coalesce(1))
    cores, _ = scratch.write(unwrapped(typed, "name", wrapping))
    whole = forms.select("db_id", F.array_join("words", "").alias("r"), "words")
    short = unwrapped(whole.select("r", "words").dropDuplicates(["r"]), "r", wrapping).join(whole.select("r", "db_id"), "r").select("db_id", F.col("core").alias("r"))
    refs, _ = scratch.write(whole.select("db_id", "r").unionByName(short).groupBy("r").agg(F.min("db_id").alias("db_id")).coalesce(1))
    left = cores.filter("core <> ''").select(F.col("core").alias("l")).distinct().withColumn("s", tokens_udf("l"))
    close = set_similarity_join(left, refs.select("r", tokens_udf("r").alias("s")), SIMILAR, scratch).join(refs, "r")
    best = close.groupBy("l").agg(F.max_by(F.struct("db_id", "jaccard"), F.struct("jaccard", -F.col("db_id"))).alias("b")).select(F.col("l").alias("core"), "b.db_id", "b.jaccard")
    return cores.join(best, "core", "left").select("name", F.coalesce("db_id", F.lit(-1)).alias("db_id"), F.coalesce("jaccard", F.lit(0.0)).alias("score"))


def map_submissions(submissions: DataFrame, registry: DataFrame) -> DataFrame:
    """p4: (submission_id, side, db_id), one row per name in src_db and dst_db that isn't null or blank; -1 where no entry is meant.

    Repeated names are matched once. Empty tables give no rows (an empty registry: -1 for all); extra columns are ignored.
    """
    sides = F.array(F.struct(F.lit("src").alias("side"), F.col("src_db").alias("name")), F.struct(F.lit("dst").alias("side"), F.col("dst_db").alias("name")))
    rows = submissions.select("submission_id", F.inline(sides)).filter(filled("name").isNotNull())
    scratch = Scratch(submissions.sparkSession, "typed")
    matched, _ = scratch.write(match_names(rows.select("name").distinct(), registry).select("name", "db_id"))
    return lookup(rows, "name", matched, "name", heavy_keys(rows, "name")).select("submission_id", "side", "db_id")
