"""Fill-in-the-middle: each text is cut at two seeded places and written as prefix, suffix and middle.

A pandas UDF takes Arrow batches of ids and texts. The `regex` library's finditer goes over a text's units (code points
unless another pattern is asked for) and their end offsets are kept in one compact array of unsigned integers, so a cut
after k units is one lookup. Two lookups give the three slices; hashlib gives the seeds, from the id alone, and the
digests of what is written and of what `restored` makes of it. A row needs no other row, so nothing is shuffled.

Units need not cover a text: what lies between two units goes with the later one, what follows the last unit is suffix.

Defined cases: a null or empty text is plain, of zero units; a text that holds a marker is plain, as it could not be
told apart afterwards; a null id is seeded as the empty string; a very long text is cut whole (four bytes a unit in
memory, one text at a time); repeated rows and repeated ids give the same cut each; an empty table gives an empty result;
further input columns, whatever their names, are kept by `transformed` and not read.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
FIELDS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string", "output_sha256": "string", "restored_sha256": "string"}


@dataclass(frozen=True)
class Plan:
    """How texts are cut. Of a hundred texts that can be cut, `rate` are, and of a hundred of these `spm` have the suffix first."""

    unit: str = r"(?s)."
    rate: int = 90
    spm: int = 20
    seed: str = "1:"


PRODUCTION = Plan()


def unit_ends(text: str, pattern: regex.Pattern) -> array:
    """The offset behind each unit of text, from left to right."""
    end = type(pattern.match("") or regex.match("", "")).end
    return array("I", map(end, pattern.finditer(text, concurrent=False)))  # keeping the lock halves the time of a short match


def seeds(ident: object, plan: Plan) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of an id."""
    name = "" if ident is None or ident != ident else str(ident)
    digest = hashlib.sha256(f"{plan.seed}{name}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def cut_text(ident: object, text: str | None, plan: Plan, pattern: regex.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, characters of the middle, output) of one text."""
    text = text or ""
    ends = unit_ends(text, pattern)
    n = len(ends)
    one, two, whether, which = seeds(ident, plan)
    if not text or whether % 100 >= plan.rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if which % 100 < plan.spm:
        return n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str | None, form: str) -> str:
    """The text that an output was made of. No marker can arise across a seam, as each starts and ends with a letter of its own."""
    if form == PLAIN:
        return output or ""
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    head, _, rest = output[len(first) :].partition(second)
    inner, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (head, inner) if form == PSM else (inner, head)
    return prefix + middle + suffix


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def cutter(plan: Plan = PRODUCTION, fields: tuple[str, ...] = tuple(FIELDS)):
    """A pandas UDF of (id, text) that gives a struct of the asked FIELDS."""

    @F.pandas_udf(", ".join(f"{f} {FIELDS[f]}" for f in fields))
    def run(idents: pd.Series, texts: pd.Series) -> pd.DataFrame:
        pattern = regex.compile(plan.unit)
        columns: dict[str, list] = {f: [] for f in fields}
        for ident, text in zip(idents, texts, strict=True):
            n, form, prefix, middle, output = cut_text(ident, text, plan, pattern)
            row = {"n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle, "output": output}
            if "output_sha256" in columns:
                row["output_sha256"] = _sha256(output)
            if "restored_sha256" in columns:
                row["restored_sha256"] = _sha256(restored(output, form))
            for f, column in columns.items():
                column.append(row[f])
        return pd.DataFrame({f: pd.Series(c, dtype="Int64" if FIELDS[f] == "long" else object) for f, c in columns.items()})

    return run


def restorer():
    """A pandas UDF of (output, form) that gives the text an output was made of."""

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restored(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return run


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = PRODUCTION, fields: tuple[str, ...] = tuple(FIELDS), into: str = "fim") -> DataFrame:
    """docs with one more column, a struct of the asked FIELDS: the written text is `output`."""
    found = cutter(plan, fields)(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"))
    return docs.withColumn(into, found)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = PRODUCTION) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): the digests alone leave the workers."""
    fields = tuple(f for f in FIELDS if f != "output")
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return transformed(slim, "doc_id", "text", plan, fields).select("doc_id", "fim.*")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM s
),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
