"""Text functions over columns: paths, entities, placeholders, sentences, validators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailgraph.vocabulary import MALWARE_TERMS


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_chars(c: Column, chars: str) -> Column:
    """Without any of ``chars`` at both ends."""
    return F.btrim(c, F.lit(chars))


def path_steps(c: Column) -> Column:
    """Steps of the first ``<PATH>a<SEP>b</PATH>``; an empty array without one."""
    body = F.regexp_extract(c, r"(?d)<PATH>(.*?)</PATH>", 1)
    return F.when(c.rlike(r"(?d)<PATH>.*?</PATH>"), F.split(body, "<SEP>")).otherwise(F.array().cast("array<string>"))


def path_text(steps: Column) -> Column:
    return F.concat(F.lit("<PATH>"), F.concat_ws("<SEP>", steps), F.lit("</PATH>"))


def final_path(c: Column) -> Column:
    """The first tagged path after the cue, or of the whole text; null without one."""
    cue = "The completed path is:"
    block = F.when(c.contains(cue), F.regexp_extract(c, rf"(?s){cue}(.*)", 1)).otherwise(c)
    return F.nullif(F.regexp_extract(block, r"(?s)<PATH>.*?</PATH>", 0), F.lit(""))


def ends_path(c: Column) -> Column:
    return strip(c).endswith("</PATH>")


_SINGLE = "Let's reason step by step, starting from the entity"
_MANY = "We are working with the following entities:"
_STOPS = ("**Objective**", "**Starting Point", "**Step-by-Step", "**Entity")


def entities(c: Column) -> Column:
    """Entity names that a generated text starts from: one after its cue, or a dashed list after the other cue."""
    after = F.regexp_extract(c, rf"(?s){_SINGLE} (.*)", 1)
    one = strip_chars(strip(F.substring_index(after, " (", 1)), "'")
    listed = F.regexp_extract(c, rf"(?s){_MANY}(.*)", 1)
    for stop in _STOPS:
        listed = F.substring_index(listed, stop, 1)

    def name(raw: Column) -> Column:
        for gone in (" is a malware", " is a tool", " is an intrusion set", "'"):
            raw = F.replace(raw, F.lit(gone), F.lit(""))
        return strip(F.regexp_extract(raw, r"^[^\r\n]*", 0))

    many = F.filter(F.transform(F.filter(F.transform(F.split(listed, "-"), strip), lambda x: x != ""), name), lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.when(c.contains(_SINGLE + " "), F.when(one != "", F.array(one)).otherwise(none)).when(c.contains(_MANY), many).otherwise(none)


def first_sentence(c: Column) -> Column:
    """A description's first sentence without parentheses and brackets; null if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(c, r"(?d)\(.*?\)", ""), r"\[|\]", "")
    # The leftmost run without a full stop that ends in one before white space or the end; cut by literals, so that a
    # long text costs one pass.
    ends = clean.rlike(r"\.(?:\s|$)")
    before = F.element_at(F.split(clean, r"\.(?=\s|$)", 2), 1)
    return F.nullif(F.when(ends, strip(F.concat(F.substring_index(before, ".", -1), F.lit(".")))).otherwise(clean), F.lit(""))


def placeholders(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?d)\[(.*?)\]"), F.lit(1))


def bracketed(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?d)(\[.*?\])"), F.lit(1))


def replace_once(text: Column, marks: Sequence[Column], values: Sequence[Column]) -> Column:
    """Each mark's first occurrence, in order."""
    for mark, value in zip(marks, values):
        at = F.instr(text, mark)
        cut = F.concat(F.substring(text, F.lit(1), at - 1), value, F.substring(text, at + F.length(mark), F.length(text)))
        text = F.when(at > 0, cut).otherwise(text)
    return text


def replace_map(text: Column, names: Column) -> Column:
    """All ``[key]`` of a map column."""
    return F.aggregate(F.map_entries(names), text, lambda s, e: F.replace(s, F.concat(F.lit("["), e["key"], F.lit("]")), e["value"]))


def malware_terms(c: Column) -> Column:
    return F.filter(F.array(*map(F.lit, MALWARE_TERMS)), lambda t: F.contains(F.lower(F.coalesce(c, F.lit(""))), t))


def _same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def keeps_brackets(question: Column, objective: Column) -> Column:
    return _same_set(bracketed(question), bracketed(objective))


def valid_paraphrase(question: Column, variation: Column) -> Column:
    return keeps_brackets(question, variation) & _same_set(malware_terms(question), malware_terms(variation))


def top_paraphrases(question: Column, candidates: Column, most: int) -> Column:
    """The first ``most`` of an array of candidates that keep the question's brackets and terms."""
    return F.slice(F.filter(candidates, lambda c: valid_paraphrase(question, c)), 1, most)


def objective(c: Column) -> Column:
    """A generated objective without white space and quotes around it."""
    return strip(strip_chars(strip(c), '"'))


def question_lines(c: Column) -> Column:
    """Lines that look like questions or enumerations, without their numbers."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\R"), strip), lambda x: x != "")
    kept = F.filter(lines, lambda x: x.contains("?") | x.rlike(r"^\d\d") | x.rlike(r"^\d$") | x.rlike(r"^(?:[1-9]|1\d|20)\. "))
    return F.transform(kept, lambda x: F.when(F.contains(F.substring(x, 1, 4), F.lit(". ")), strip(F.regexp_extract(x, r"(?s)^.*?\. (.*)$", 1))).otherwise(x))


def variations(c: Column, separator: str = "; ") -> Column:
    return F.filter(F.transform(F.split(c, separator), strip), lambda x: x != "")


def pick(options: Column, policy: str) -> Column:
    """The first option, or the longest (the first of equals); null of none."""
    if policy == "first":
        return F.try_element_at(options, F.lit(1))
    longest = F.aggregate(options, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return F.nullif(longest, F.lit(""))


def joined_variations(c: Column, listed: bool = True) -> Column:
    """An array joined by "; ", or (not ``listed``) a text as it is; null is empty."""
    return F.coalesce(F.concat_ws("; ", c) if listed else c, F.lit(""))


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))
