"""Column functions on drawing texts and generated scripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The signs for a diameter, all written as the first.
DIAMETERS = "Φ⌀φØ"
_STRIP = r"(?U)^\s+|\s+$"
#: Imports that generated scripts get wrong, the one they need, and the exporter's full name.
WRONG_IMPORTS = ("from cq import *", "import cq", "from cadquery import *")
RIGHT_IMPORT = "import cadquery as cq"
EXPORT_CALL = "cq.exporters.export("


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _STRIP, "")


def normalised_dimension(text: Column) -> Column:
    """A dimension's text with one diameter sign, no spaces, in capitals."""
    one_sign = F.translate(stripped(text), DIAMETERS[1:], DIAMETERS[0] * 3)
    return F.upper(F.replace(one_sign, F.lit(" "), F.lit("")))


def leading_quantity(text: Column) -> Column:
    """How many features a dimension stands for, as in 4-M3 or 4x5; null where it doesn't say."""
    return F.regexp_extract(text, r"^\s*(\d+)\s*[xX×-]", 1).try_cast("int")


def first_number(text: Column) -> Column:
    """The first run of digits and points; null if that's no number."""
    return F.regexp_extract(text, r"\d[\d.]*", 0).try_cast("double")


def dimension_value(text: Column) -> Column:
    """The number after the quantity, or the first one."""
    after = F.regexp_replace(text, r"^\s*\d+\s*[xX×-]", "")
    return F.when(leading_quantity(text).isNotNull(), first_number(after)).otherwise(first_number(text))


def best_diameter(text: Column, preferred: Sequence[float]) -> Column:
    """The first preferred diameter that the text names, else the first named, else the first preferred."""
    named = F.transform(F.regexp_extract_all(text, F.lit(r"[ΦØ]\s*(\d+(?:\.\d+)?)"), 1), lambda x: x.try_cast("double"))
    wanted = F.filter(F.array(*[F.lit(float(p)) for p in preferred]), lambda p: F.array_contains(named, p))
    return F.coalesce(F.get(wanted, F.lit(0)), F.get(named, F.lit(0)), F.lit(float(preferred[0])))


def depth(text: Column, otherwise: float) -> Column:
    """The number after the word for depth."""
    return F.coalesce(F.regexp_extract(text, r"(?i)(?:深|depth)\s*(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(otherwise))


def mentions_thread(texts: Column) -> Column:
    """Whether any text, in capitals, holds the letter that marks metric threads."""
    return F.coalesce(F.exists(texts, lambda t: F.contains(F.upper(t), F.lit("M"))), F.lit(False))


def unfenced(text: Column) -> Column:
    """What the first code fence holds, or all of it."""
    fence = "`" * 3
    pattern = f"(?is){fence}(?:python|py)?\\s*(.*?){fence}"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def _fixed_imports(code: Column) -> Column:
    lines = F.filter(F.split(code, "\n", -1), lambda line: ~F.trim(line).isin(*WRONG_IMPORTS))
    has = F.exists(lines, lambda line: F.trim(line) == RIGHT_IMPORT)
    future = F.startswith(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), F.lit("from __future__"))
    put_in = F.when(future, F.concat(F.slice(lines, 1, 1), F.array(F.lit(RIGHT_IMPORT)), F.slice(lines, F.lit(2), F.size(lines)))).otherwise(F.concat(F.array(F.lit(RIGHT_IMPORT)), lines))
    return F.array_join(F.when(has, lines).otherwise(put_in), "\n")


def sanitised_script(text: Column) -> Column:
    """A generated script that can run: out of its fence, with the right import, exports by their full name."""
    code = _fixed_imports(stripped(unfenced(text)))
    named = F.regexp_replace(code, r"(?<![\w.])export\(", EXPORT_CALL)
    return F.concat(F.regexp_replace(named, r"(?U)\s+$", ""), F.lit("\n"))
