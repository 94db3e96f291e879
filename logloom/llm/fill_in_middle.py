"""Fill-in-the-middle: escaped markers put after each unit, ranked parts cut out and put together again.

Everything is a SQL function over one row: no shuffle, no Python. The delimiter and the escape
sign are control characters; where a text holds them they are escaped first, so that each
delimiter in the marked text ends a unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sign that ends a unit, and the sign that escapes both; an escape is followed by 0 (itself) or 1 (the delimiter).
DELIMITER, ESCAPE = "\x1e", "\x1f"
#: Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Of 100 documents about so many stay plain, and of the others so many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def unescaped(text: Column) -> Column:
    """The text of a part: without the delimiters after its units, and escapes undone."""
    plain = F.replace(text, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(plain, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def marked(text: Column) -> Column:
    """The escaped text with a delimiter after each unit: a run of ASCII letters, or one other code point (an escape stands for one)."""
    return F.regexp_replace(escaped(text), f"{ESCAPE}[01]|[A-Za-z]+|[^A-Za-z]", f"$0{DELIMITER}")


def units(text: Column) -> Column:
    """How many units a marked text has."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(DELIMITER), F.lit("")))).cast("long")


def first_units(text: Column, n: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(DELIMITER), n.cast("int"))


def part(text: Column, low: Column, high: Column) -> Column:
    """The units after the first low up to the first high of a marked text, unescaped."""
    head = first_units(text, high)  # with high - 1 delimiters: the last one is cut off
    return unescaped(F.when(high <= low, "").when(low == 0, head).otherwise(F.call_function("substring_index", head, F.lit(DELIMITER), (low - high).cast("int"))))


def draws(id_column: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits that follow from seed and id; a null id counts as the empty text."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Per row: id, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain), output.

    The cuts come at two drawn units: a part may be empty. Plain are a drawn share of plain %,
    empty texts and texts that hold one of the markers; of the others suffix_first % have the
    suffix first. A null text is empty; repeated rows give repeated rows; an empty table gives
    none; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), marked(text).alias("marked"), *[d.alias(f"h{k}") for k, d in enumerate(draws(F.col(id_col), seed), 1)])
    rows = rows.withColumn("n", units(F.col("marked")))
    cuts = [F.pmod(F.col(h), F.col("n") + 1) for h in ("h1", "h2")]
    rows = rows.withColumns({"low": F.least(*cuts), "high": F.greatest(*cuts)})
    keeps = F.col("text") == ""
    for marker in MARKERS:
        keeps = keeps | F.contains("text", F.lit(marker))
    form = F.when(keeps | (F.col("h3") % 100 >= 100 - plain), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    n = F.col("n")
    rows = rows.withColumn("form", form)
    moved = F.col("form") != "plain"
    rows = rows.withColumns({
        "prefix": F.when(moved, part(F.col("marked"), F.lit(0), F.col("low"))),
        "middle": F.when(moved, part(F.col("marked"), F.col("low"), F.col("high"))),
        "suffix": F.when(moved, part(F.col("marked"), F.col("high"), n)),
    })
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select(F.col("id").alias(id_col), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(form: Column, output: Column) -> Column:
    """The text before the transformation, from output and form alone: no part of it holds a marker, and markers can't overlap."""
    width = len(PREFIX)
    after = lambda head, rest: F.substring(rest, F.char_length(head) + F.lit(width + 1), F.char_length(rest))
    body = F.substring(output, F.lit(width + 1), F.char_length(output))
    one = F.substring_index(body, SUFFIX, 1)
    psm_rest = after(one, body)
    psm_suffix = F.substring_index(psm_rest, MIDDLE, 1)
    psm = F.concat(one, after(psm_suffix, psm_rest), psm_suffix)
    two = F.substring_index(body, PREFIX, 1)
    spm_rest = after(two, body)
    spm_prefix = F.substring_index(spm_rest, MIDDLE, 1)
    spm = F.concat(spm_prefix, after(spm_prefix, spm_rest), two)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def middle_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lengths and digests of the parts, the output and the text rebuilt from it."""
    length = lambda name: F.char_length(name).cast("long").alias(f"{name}_chars")
    return found.select(id_col, "n", "form", length("prefix"), length("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))
