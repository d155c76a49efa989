"""Facts of a window as cited lines, and checking texts that cite them.

Texts are cut into sentences and numbers with built-in expressions; whether a
number, a gene or a column stands in the cited lines is decided by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions import vocab
from seqweave.operators.graph import top_k
from seqweave.operators.tiling import islands

NUMBER = r"(?:(RGP|named|share) )?(\d+(?:\.\d+)?)(%| bits| families)"
CITED = r"([^{}]+)\{([^{}]*)\}"
EXACT = "decimal(18,6)"


def column_kinds(nodes: DataFrame, genomes: Column, spine: float = 0.9, fork: float = 0.1) -> DataFrame:
    """Per column the most carried family, its share and the second one's, the mean
    share inside plastic regions, and the kind: spine, fork or variable.

    ``nodes``: locus, family, carriers, rgp.
    """
    best = top_k(nodes, ["locus"], [F.desc("carriers"), F.col("family")], 2)
    pick = lambda place, c: F.max(F.when(F.col("place") == place, F.col(c)))
    two = best.groupBy("locus").agg(
        pick(1, "family").alias("top"), pick(1, "carriers").alias("n1"), pick(2, "carriers").alias("n2"),
        pick(2, "family").alias("second"),
    )
    mean = nodes.groupBy("locus").agg(
        (F.sum(F.col("carriers") * F.col("rgp")) / F.sum("carriers")).alias("rgp")
    )
    rows = two.join(mean, "locus").withColumn("_g", genomes)
    s1, s2 = F.col("n1") / F.col("_g"), F.coalesce("n2", F.lit(0)) / F.col("_g")
    kind = F.when(s1 >= spine, "spine").when(s2 >= fork, "fork").otherwise("variable")
    return rows.select("locus", "top", "second", s1.alias("s1"), s2.alias("s2"), "rgp", kind.alias("kind"))


def column_runs(columns: DataFrame, value: str = "kind", out: str = "run") -> DataFrame:
    """Number the runs of consecutive columns of equal ``value``."""
    return islands(
        columns,
        [],
        lambda w: ~F.col(value).eqNullSafe(F.lag(value).over(w))
        | F.coalesce(F.lag("locus").over(w) != F.col("locus") - 1, F.lit(True)),
        out,
        pos="locus",
    )


def prefix_groups(columns: DataFrame, prefix: Column, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` columns whose families share a prefix: prefix, first, last, n."""
    runs = column_runs(columns.withColumn("prefix", prefix), "prefix", "_run")
    return (
        runs.groupBy("_run", "prefix")
        .agg(F.min("locus").alias("first"), F.max("locus").alias("last"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
        .drop("_run")
    )


def word_groups(columns: DataFrame, gap: int = 2, least: int = 3, filled: float = 0.6, agree: float = 0.5, shortest: int = 5) -> DataFrame:
    """Runs of columns whose products share a word: word, first, last, hits, words.

    ``columns``: locus, words (array of the words of its product). Columns with the word up to ``gap`` apart make a
    run; it needs ``least`` of them and the share ``filled`` of its stretch, and a word ``shortest`` letters. ``words`` are up to four of the
    words of four letters or more that the share ``agree`` of the stretch's columns, and two at least, carry, most
    frequent first. Words are counted along their own columns, so a common word makes one row a column that has it.
    """
    spoken = columns.select("locus", F.explode(F.array_distinct("words")).alias("word"))
    along = Window.partitionBy("word").orderBy("locus")
    fresh = F.coalesce((F.col("locus") - F.lag("locus").over(along) > gap).cast("int"), F.lit(1))
    runs = spoken.where(F.length("word") >= shortest).withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(along))
    found = runs.groupBy("word", "_run").agg(F.min("locus").alias("first"), F.max("locus").alias("last"), F.count(F.lit(1)).alias("hits"))
    width = F.col("last") - F.col("first") + 1
    found = found.where((F.col("hits") >= least) & (F.col("hits") >= filled * width)).drop("_run")
    # the columns of one window
    inside = found.join(spoken.select("locus", F.col("word").alias("said")), F.col("locus").between(F.col("first"), F.col("last")))
    many = inside.where(F.length("said") >= 4).groupBy("word", "first", "last", "hits", "said").agg(F.count(F.lit(1)).alias("n"))
    many = many.where((F.col("n") >= 2) & (F.col("n") >= agree * (F.col("last") - F.col("first") + 1)))
    ranked = many.groupBy("word", "first", "last", "hits").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "said"))).alias("w"))
    return ranked.select("word", "first", "last", "hits", F.transform(F.slice("w", 1, 4), lambda x: x["said"]).alias("words"))


def branch_groups(branches: DataFrame, agree: float = 0.5) -> DataFrame:
    """Branches whose families agree in words: branch, first, last, words.

    ``branches``: branch, locus, words. Words of four letters or more that the share ``agree`` of a branch's
    families, and two at least, carry; up to four, most frequent first.
    """
    size = branches.groupBy("branch").agg(F.count(F.lit(1)).alias("size"), F.min("locus").alias("first"), F.max("locus").alias("last"))
    said = branches.select("branch", F.explode(F.array_distinct("words")).alias("said")).where(F.length("said") >= 4)
    many = said.groupBy("branch", "said").agg(F.count(F.lit(1)).alias("n")).join(size, "branch")
    many = many.where((F.col("n") >= 2) & (F.col("n") >= agree * F.col("size")))
    ranked = many.groupBy("branch", "first", "last").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "said"))).alias("w"))
    return ranked.select("branch", "first", "last", F.transform(F.slice("w", 1, 4), lambda x: x["said"]).alias("words"))


def parallel_branches(columns: DataFrame, edges: DataFrame, share: float = 0.5) -> DataFrame:
    """Second families of neighbouring fork columns that follow one another in at least
    ``share`` of the smaller one's genomes: locus, second, next.

    ``columns`` needs locus, second, n2 and kind; ``edges``: prev, family, genomes.
    """
    forks = columns.where((F.col("kind") == "fork") & F.col("second").isNotNull())
    here = forks.select("locus", F.col("second").alias("prev"), F.col("n2").alias("n_here"))
    after = forks.select((F.col("locus") - 1).alias("locus"), F.col("second").alias("family"), F.col("n2").alias("n_after"))
    return (
        here.join(after, "locus")
        .join(edges, ["prev", "family"])
        .where(F.col("genomes") >= share * F.least("n_here", "n_after"))
        .select("locus", F.col("prev").alias("second"), F.col("family").alias("next"))
    )


def whole(x: Column) -> Column:
    """A share as a whole percentage, half up."""
    return F.round(x * 100).cast("bigint").cast("string")


def hundredths(x: Column) -> Column:
    """Two decimals, half up, as text."""
    cents = F.round(x * 100).cast("bigint")
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def column_lines(columns: DataFrame, calls: DataFrame) -> DataFrame:
    """One facts line per column: line_id, locus, top, text.

    ``columns`` with run; ``calls``: locus, named (share), entropy.
    """
    text = F.concat(
        F.lit("column "), F.col("locus").cast("string"), F.lit(": `"), F.col("top"), F.lit("` share "), whole(F.col("s1")),
        F.lit("%, named "), whole(F.col("named")), F.lit("%, "), hundredths(F.col("entropy")), F.lit(" bits; RGP "),
        whole(F.col("rgp")), F.lit("%"),
    )
    line = F.concat(F.lit("S"), F.col("run").cast("string"), F.lit(".c"), F.col("locus").cast("string"))
    return columns.join(calls, "locus").select(line.alias("line_id"), "locus", "top", "kind", text.alias("text"))


def numbers(rows: DataFrame, *keep: str) -> DataFrame:
    """Numbers of a text with the role the word before or the unit after gives them."""
    found = rows.select(
        *keep,
        F.posexplode(
            F.arrays_zip(
                F.regexp_extract_all("text", F.lit(NUMBER), F.lit(1)).alias("word"),
                F.regexp_extract_all("text", F.lit(NUMBER), F.lit(2)).alias("value"),
                F.regexp_extract_all("text", F.lit(NUMBER), F.lit(3)).alias("unit"),
            )
        ).alias("nth", "x"),
    )
    unit = F.trim("x.unit")
    role = F.when(unit == "bits", "bits").when(unit == "families", "count").when(F.col("x.word") != "", F.col("x.word")).otherwise("share")
    return found.select(*keep, "nth", role.alias("role"), F.col("x.value").alias("value"))


def allowed_values(line_numbers: DataFrame) -> DataFrame:
    """What a text may write for each number of a line: itself, or rounded further, half
    up or half even; bits keep one decimal, and a share is never rounded to 0 or 100."""
    v = F.col("value").cast(EXACT)
    exact = lambda x: x.cast(EXACT)
    tenths = [exact(F.round(v, 1)), exact(F.bround(v, 1))]
    units = [exact(F.round(v, 0)), exact(F.bround(v, 0))]
    options = F.when(F.col("role") == "bits", F.array(v, *tenths)).otherwise(F.array(v, *tenths, *units))
    spread = line_numbers.select("line_id", "role", v.alias("own"), F.explode(F.array_distinct(options)).alias("allowed"))
    edge = F.col("allowed").isin(0, 100) & (F.col("allowed") != F.col("own")) & ~F.col("role").isin("bits", "count")
    return spread.where(~edge).select("line_id", "role", "allowed").distinct()


def sentences(texts: DataFrame) -> DataFrame:
    """Sentences, each ending at the citations in braces: text_id, nth, text, cites.

    ``texts``: text_id, body. Words after the last citation are left out.
    """
    pairs = F.arrays_zip(
        F.regexp_extract_all("body", F.lit(CITED), F.lit(1)).alias("text"),
        F.regexp_extract_all("body", F.lit(CITED), F.lit(2)).alias("cites"),
    )
    return texts.select("text_id", F.posexplode(pairs).alias("nth", "s")).select(
        "text_id",
        "nth",
        F.trim(F.regexp_replace("s.text", r"^[.;:!? ]+", "")).alias("text"),
        F.split("s.cites", r"[,; ]+").alias("cites"),
    )


def unsupported_numbers(cut: DataFrame, lines: DataFrame) -> DataFrame:
    """Numbers of sentences that no cited line shows in that role: text_id, nth, role, value."""
    said = numbers(cut.withColumnRenamed("nth", "sentence"), "text_id", "sentence", "cites")
    claims = said.select(
        "text_id", "sentence", "nth", "role", "value", F.col("value").cast(EXACT).alias("allowed"), F.explode("cites").alias("line_id")
    )
    shown = allowed_values(numbers(lines, "line_id"))
    held = claims.join(shown, ["line_id", "role", "allowed"], "left_semi").select("text_id", "sentence", "nth").distinct()
    every = said.select("text_id", "sentence", "nth", "role", "value")
    return every.join(held, ["text_id", "sentence", "nth"], "left_anti").select(
        "text_id", F.col("sentence").alias("nth"), "role", "value"
    )


def unsupported_names(cut: DataFrame, lines: DataFrame) -> DataFrame:
    """Names in backquotes that stand in none of the cited lines: text_id, nth, name."""
    quoted = lambda c: F.regexp_extract_all(c, F.lit("`([^`]+)`"), F.lit(1))
    said = cut.select("text_id", "nth", F.explode(quoted("text")).alias("name"), "cites")
    shown = lines.select("line_id", F.explode(quoted("text")).alias("name")).distinct()
    held = (
        said.select("text_id", "nth", "name", F.explode("cites").alias("line_id"))
        .join(shown, ["line_id", "name"], "left_semi").select("text_id", "nth", "name").distinct()
    )
    return said.select("text_id", "nth", "name").distinct().join(held, ["text_id", "nth", "name"], "left_anti")


def unsupported_columns(cut: DataFrame, lines: DataFrame) -> DataFrame:
    """Columns named with a kind that is not theirs, or not covered by the cited lines:
    text_id, nth, locus, why."""
    pattern = r"(?:(spine|fork|variable) )?column (\d+)"
    said = cut.select(
        "text_id", "nth", "cites",
        F.explode(
            F.arrays_zip(
                F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("kind"),
                F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("locus"),
            )
        ).alias("c"),
    ).select("text_id", "nth", "cites", F.col("c.kind").alias("said"), F.col("c.locus").cast("bigint").alias("locus"))
    known = lines.select("line_id", F.col("locus").cast("bigint").alias("locus"), "kind")
    kinds = known.select("locus", "kind").distinct()
    cited = (
        said.select("text_id", "nth", "locus", F.explode("cites").alias("line_id"))
        .join(known.select("line_id", "locus"), ["line_id", "locus"], "left_semi")
        .select("text_id", "nth", "locus").distinct().withColumn("covered", F.lit(True))
    )
    judged = said.join(kinds, "locus", "left").join(cited, ["text_id", "nth", "locus"], "left")
    why = F.when(F.col("covered").isNull(), "not covered").when(
        (F.col("said") != "") & ~F.col("said").eqNullSafe(F.col("kind")), "kind"
    )
    return judged.select("text_id", "nth", "locus", why.alias("why")).where(F.col("why").isNotNull()).distinct()


def wording_faults(cut: DataFrame) -> DataFrame:
    """Sentences with wording a reading may not use: text_id, nth, fault."""
    only = F.regexp_extract("text", vocab.ONLY_SHARE, 1)
    faults = F.array_compact(
        F.array(
            F.when(F.col("text").rlike(vocab.NEGATION), F.lit("negation")),
            F.when(F.col("text").rlike(vocab.SUPERLATIVE), F.lit("superlative")),
            F.when(F.col("text").rlike(vocab.VAGUE_NUMBER), F.lit("vague number")),
            F.when(F.col("text").rlike(vocab.EASE), F.lit("ease")),
            F.when((only != "") & (only.try_cast("double") >= 50), F.lit("only before a majority")),
        )
    )
    return cut.select("text_id", "nth", F.explode(faults).alias("fault"))


def false_extremes(cut: DataFrame, lines: DataFrame) -> DataFrame:
    """"Most hesitant at column N" claims whose column has not the most bits: text_id, nth, locus."""
    bits = numbers(lines, "locus").where(F.col("role") == "bits").select("locus", F.col("value").cast(EXACT).alias("bits"))
    top = bits.agg(F.max("bits")).scalar()
    peaks = bits.where(F.col("bits") == top).select(F.col("locus").cast("bigint").alias("locus"))
    said = F.regexp_extract("text", r"most hesitant at column (\d+)", 1)
    claims = cut.select("text_id", "nth", said.alias("c")).where(F.col("c") != "")
    return claims.select("text_id", "nth", F.col("c").cast("bigint").alias("locus")).join(peaks, "locus", "left_anti")


def backward_order(cut: DataFrame) -> DataFrame:
    """Sentences that say "then" or "after" but cite columns before those of the sentence
    before them: text_id, nth. Sentences of one text are few: a text is one row."""
    first = F.array_min(
        F.transform(F.filter("cites", lambda c: c.rlike(r"\.c\d+$")), lambda c: F.regexp_extract(c, r"\.c(\d+)$", 1).cast("bigint"))
    )
    seen = cut.select("text_id", "nth", "text", first.alias("first"))
    before = seen.select("text_id", (F.col("nth") + 1).alias("nth"), F.col("first").alias("prior"))
    moved = seen.join(before, ["text_id", "nth"])
    return moved.where(F.col("text").rlike(r"(?i)\b(then|after)\b") & (F.col("first") < F.col("prior"))).select("text_id", "nth")


def kept_sentences(cut: DataFrame, faults: DataFrame, words: int) -> DataFrame:
    """What remains of each text: faulty sentences and repeats dropped, cut at a number of words.

    text_id, kept (sentences), body. Works on the sentence list of one text.
    """
    good = cut.join(faults.select("text_id", "nth").distinct(), ["text_id", "nth"], "left_anti")
    unique = good.groupBy("text_id", "text").agg(F.min("nth").alias("nth"))
    listed = unique.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("s"))
    size = lambda x: F.size(F.split(x["text"], " "))
    zero = F.struct(F.lit(0).alias("words"), F.array().cast("array<string>").alias("out"))

    def add(acc, x):
        total = acc["words"] + size(x)
        keep = F.struct(total.alias("words"), F.concat(acc["out"], F.array(x["text"])).alias("out"))
        stop = F.struct(F.lit(words + 1).alias("words"), acc["out"].alias("out"))
        return F.when(total <= words, keep).otherwise(stop)

    folded = listed.select("text_id", F.aggregate("s", zero, add)["out"].alias("out"))
    return folded.select("text_id", F.size("out").alias("kept"), F.array_join("out", ". ").alias("body"))


def tidy(text: Column) -> Column:
    """Plain quotes and hyphens, single spaces, none before punctuation."""
    plain = F.translate(text, "“”‘’–‑ ", "\"\"''-- ")
    spaced = F.regexp_replace(plain, r"\s+", " ")
    return F.trim(F.regexp_replace(spaced, r" +([.,;:!?%])", "$1"))
