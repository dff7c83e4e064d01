"""Punctuation and case labels of words."""

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cases and marks that a label combines, in the order that numbers them from 1.
CASES = ["LOWER", "UPPER", "UPPER_TOTAL"]
MARKS = {"O": "", "PERIOD": ".", "COMMA": ",", "QUESTION": "?"}

LABELS = {k: f"{case}_{mark}" for k, (case, mark) in enumerate(product(CASES, MARKS), 1)}


def label_name(label: Column) -> Column:
    """A label's name; O for -100 and anything else."""
    names = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(F.element_at(names, label.cast("int")), F.lit("O"))


def surface(word: Column, label: Column) -> Column:
    """The word in a label's case with its mark; unchanged for labels outside 1 to 12."""
    number = label.cast("int") - 1
    case, mark = F.floor(number / len(MARKS)), F.pmod(number, F.lit(len(MARKS)))
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))
    cased = F.when(case == 1, capital).when(case == 2, F.upper(word)).otherwise(word)
    marks = F.array(*(F.lit(m) for m in MARKS.values()))
    return F.when(label.between(1, len(LABELS)), F.concat(cased, F.get(marks, mark))).otherwise(word)


def surface_text(word: str, label: int) -> str:
    """As ``surface``, of one word."""
    if not 1 <= label <= len(LABELS):
        return word
    case, mark = divmod(label - 1, len(MARKS))
    return (word, word[:1].upper() + word[1:].lower(), word.upper())[case] + [*MARKS.values()][mark]


def best_label(logits: Column) -> Column:
    """The number of the largest logit, from 0; the first of equals."""
    return F.array_position(logits, F.array_max(logits)) - 1
