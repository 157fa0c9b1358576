"""Fill-in-the-middle transformation by lookaround splitting.

A unit grammar is an ordered choice of unit patterns over named classes of characters. Where a grammar's borders depend
on the two neighbouring characters alone, it is translated to a zero-width regular expression, one lookbehind and one
lookahead for each pair of classes with a border between them; Spark's ``split`` cuts a text there and loses nothing.
``split`` gives one empty piece for an empty text, which has no unit, so that case is set apart.

A document's random numbers are hash groups of the seed and its key: two cuts at unit borders make prefix, middle and
suffix, and two further numbers choose the form. Everything is made of DataFrame functions on one row; nothing is shuffled.

Defined results: a null text is an empty one; empty texts and texts that hold one of the marks stay plain. A null key counts
as an empty string. Repeated rows get equal results, an empty table gives an empty table. Columns named like an output are
replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, drop_clashing, spread, table

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Class strings of up to this length are tried when a grammar is translated.
LONGEST = 6


@dataclass(frozen=True)
class Grammar:
    """``classes`` names, by one letter each, the inside of bracket expressions that together hold every character once;
    ``units`` is a pattern over those letters, such as ``s*w+|s+``, matched again and again from left to right."""

    classes: dict[str, str]
    units: str

    def borders(self) -> list[tuple[str, str]]:
        """The pairs of neighbouring classes with a unit border between them. A grammar that leaves characters out, makes
        empty units, or sets a border between the same two classes in one place and not in another, is refused."""
        unit, seen = re.compile(self.units), {}
        for n in range(1, LONGEST + 1):
            for word in map("".join, product(self.classes, repeat=n)):
                ends, at = set(), 0
                while at < n:
                    found = unit.match(word, at)
                    if not found or found.end() == at:
                        raise ValueError(f"the units {self.units} don't cover {word!r}")
                    at = found.end()
                    ends.add(at)
                for i in range(1, n):
                    if seen.setdefault(word[i - 1 : i + 1], i in ends) != (i in ends):
                        raise ValueError(f"whether a unit ends inside {word[i - 1 : i + 1]!r} hangs on more than the neighbours")
        return [(pair[0], pair[1]) for pair, ends in seen.items() if ends]

    @property
    def boundary(self) -> str:
        """The zero-width expression; one that never matches if the whole text is one unit."""
        after: dict[str, list[str]] = {}
        for left, right in self.borders():
            after.setdefault(left, []).append(self.classes[right])
        return "|".join(f"(?<=[{self.classes[k]}])(?=[{''.join(v)}])" for k, v in sorted(after.items())) or r"(?!)"

    @property
    def pattern(self) -> str:
        """The grammar as a pattern over characters."""
        return "".join(f"[{self.classes[c]}]" if c in self.classes else c for c in self.units)


#: White space (the six ASCII characters) in front of a word belongs to it; what is left at the end is a unit.
WORDS = Grammar({"s": r"\x20\x09-\x0D", "w": r"\x00-\x08\x0E-\x1F\x21-\x{10FFFF}"}, "s*w+|s+")
#: Lines with their line feeds.
LINES = Grammar({"n": r"\x0A", "o": r"\x00-\x09\x0B-\x{10FFFF}"}, "o*n|o+")
#: Runs of white space, of ASCII letters and digits with all beyond ASCII, and of other ASCII characters, as code has them.
RUNS = Grammar({"s": r"\x20\x09-\x0D", "a": r"0-9A-Za-z_\x80-\x{10FFFF}", "p": r"\x00-\x08\x0E-\x1F!-/:-@\[-\^`{-\x7F"}, "s+|a+|p+")


def units(text: Column, grammar: Grammar = WORDS) -> Column:
    """The units of a text in order; none for an empty or null text."""
    return F.when(F.length(text) > 0, F.split(text, grammar.boundary, -1)).otherwise(F.array().cast("array<string>"))


def draws(key: Column, seed: int, count: int = 4) -> list[Column]:
    """The first ``count`` 8-digit groups of the hexadecimal SHA-256 of seed, colon and key, as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def fill_in_middle(docs: DataFrame, grammar: Grammar = WORDS, text: str = "text", key: str = "doc_id", seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """``docs`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix``, ``middle``, ``suffix`` (null if plain) and
    ``output``. ``rate`` of a hundred texts are transformed, ``suffix_first`` of a hundred of those with the suffix first."""
    made = ["n", "form", "prefix", "middle", "suffix", "output"]
    own = {x: f"{OWN}{x}" for x in ("text", "units", "h", "low", "high")}
    docs = drop_clashing(docs, [c for c in made if c != text])
    names = docs.columns
    whole, piece = F.col(own["text"]), F.col(own["units"])
    docs = docs.withColumn(own["text"], F.coalesce(text, F.lit("")))
    docs = docs.withColumns({own["units"]: units(whole, grammar), own["h"]: F.array(*draws(F.col(key), seed))})
    h, n = [F.col(own["h"])[k] for k in range(4)], F.size(piece).cast("long")
    cuts = [h[0] % (n + 1), h[1] % (n + 1)]
    held = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    form = F.when((F.length(whole) == 0) | held | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    docs = docs.withColumns({own["low"]: F.least(*cuts).cast("int"), own["high"]: F.greatest(*cuts).cast("int"), f"{OWN}n": n, f"{OWN}form": form})

    low, high, plain = F.col(own["low"]), F.col(own["high"]), F.col(f"{OWN}form") == "plain"
    part = lambda start, length: F.when(~plain, F.array_join(F.slice(piece, start + 1, length), ""))
    parts = {f"{OWN}prefix": part(F.lit(0), low), f"{OWN}middle": part(low, high - low), f"{OWN}suffix": part(high, F.size(piece) - high)}
    docs = docs.withColumns(parts)
    p, m, s = (F.col(c) for c in parts)
    spm = F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)
    psm = F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)
    output = F.when(plain, whole).when(F.col(f"{OWN}form") == "spm", spm).otherwise(psm)
    kept = [c for c in names if c.lower() not in made]
    return docs.select(*kept, *[F.col(f"{OWN}{c}").alias(c) for c in made[:5]], output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form alone. No mark can arise where parts and marks meet, as each mark begins and
    ends with characters that it holds only there; so a transformed output has exactly its three marks."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second = F.when(form == "spm", parts[2]).otherwise(parts[1]), F.when(form == "spm", parts[1]).otherwise(parts[2])
    return F.when(form == "plain", output).otherwise(F.concat(first, parts[3], second))


def query(spark, sf_dir: str) -> DataFrame:
    seen = fill_in_middle(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return seen.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM cut
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:low], '') AS p, array_to_string(units[low + 1:high], '') AS m, array_to_string(units[high + 1:], '') AS s
  FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
