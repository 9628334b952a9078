"""Column functions over prompts and tagged answers. All of them give null for null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is stripped from answers.
BLANK = " \t\n\r\f\x0b"

#: What may stand before an answer, the first that holds being dropped; and the marks dropped at its ends.
ANSWER_PREFIXES = ("answer is", "answer:", "the answer is")
ANSWER_ENDS = ".。 ,\n\t"
PREFIX_PATTERN = rf"^(?:{'|'.join(ANSWER_PREFIXES)})\s*"

#: An option line of a question, and an option named in an answer.
OPTION_LINE, OPTION_NAMED = r"\(([A-Ja-j])\)\s*([^\n]+)", r"\(([A-Ja-j])\)"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def has_tag(c: Column, tag: str) -> Column:
    return c.rlike(f"(?s)<{tag}>.*?</{tag}>")


def tag_text(c: Column, tag: str) -> Column:
    """The first span of a tag, stripped; '' without one."""
    return strip(F.regexp_extract(c, f"(?s)<{tag}>(.*?)</{tag}>", 1))


def answer_any_case(c: Column) -> Column:
    """The first answer tag in any case, else the whole text, stripped."""
    return F.when(c.rlike("(?is)<answer>.*?</answer>"), strip(F.regexp_extract(c, "(?is)<answer>(.*?)</answer>", 1))).otherwise(strip(c))


def answer_or_rest(c: Column) -> Column:
    """The first lower-case answer tag, else the text behind the last closing rethink tag, else all, stripped."""
    return F.when(has_tag(c, "answer"), tag_text(c, "answer")).otherwise(strip(F.substring_index(c, "</rethink>", -1)))


def answer_for_reward(c: Column) -> Column:
    """The answer in lower case without one of ``ANSWER_PREFIXES`` and without full stops and commas at its ends."""
    text = F.lower(F.when(has_tag(c, "answer"), tag_text(c, "answer")).otherwise(strip(c)))
    return F.btrim(F.regexp_replace(text, PREFIX_PATTERN, ""), F.lit(ANSWER_ENDS))


def answer_reward(completion: Column, solution: Column) -> Column:
    """1 where the completion's answer is not empty and equals the solution's, else 0; nulls give 0."""
    given = answer_for_reward(completion)
    return F.coalesce(((given != "") & (given == answer_for_reward(solution))).cast("double"), F.lit(0.0))


def option_letter(c: Column) -> Column:
    """The letter of "(x) species" in lower case, '' if there is none."""
    return F.regexp_extract(F.lower(strip(c)), r"\(([a-z])\)\s*(.*)", 1)


def option_species(c: Column) -> Column:
    """The species of "(x) species", or the whole text where there is no letter, in lower case."""
    low = F.lower(strip(c))
    return F.when(low.rlike(r"\([a-z]\)"), strip(F.regexp_extract(low, r"\(([a-z])\)\s*(.*)", 2))).otherwise(low)


def is_correct_option(prediction: Column, truth: Column) -> Column:
    """Whether letters or species are equal; a truth that lacks either part is never met."""
    whole = (option_letter(truth) != "") & (option_species(truth) != "")
    return F.coalesce(whole & ((option_letter(prediction) == option_letter(truth)) | (option_species(prediction) == option_species(truth))), F.lit(False))


class ClassNames:
    """The classes that texts may name: canonical names (with underscores), and an ordered table of aliases of them.

    Without aliases each canonical name is also known with blanks for its underscores. Aliases are in lower case.
    """

    def __init__(self, canonical: list[str], aliases: list[tuple[str, str]] | None = None):
        self.canonical = list(canonical)
        self.aliases = list(aliases) if aliases is not None else [(alias, c) for c in canonical for alias in (c, c.replace("_", " "))]

    def _looked_up(self, text: Column) -> Column:
        if not self.aliases:
            return F.lit(None).cast("string")
        return F.try_element_at(F.create_map(*(F.lit(x) for pair in dict(reversed(self.aliases)).items() for x in pair)), text)

    def normal(self, text: Column) -> Column:
        """The class that a text is: by its canonical name, else by the alias it is, with or without underscores; null without one."""
        low = F.lower(strip(text))
        plain = F.translate(low, "- ", "__")
        return F.coalesce(F.when(plain.isin(self.canonical), plain), self._looked_up(low), self._looked_up(F.replace(low, F.lit("_"), F.lit(" "))))

    def held(self, text: Column) -> Column:
        """The class of the first alias, in the table's order, that stands in the text."""
        table = F.array(*(F.struct(F.lit(a).alias("alias"), F.lit(c).alias("name")) for a, c in self.aliases))
        return F.get(F.filter(table, lambda x: F.contains(F.lower(text), x["alias"]))["name"], F.lit(0)) if self.aliases else F.lit(None).cast("string")


def options(question: Column, names: ClassNames) -> Column:
    """array<struct<letter, species>> of the lines "(A) species" with letters A to J whose text names a class; a null question has none."""
    letters, texts = (F.regexp_extract_all(question, F.lit(OPTION_LINE), F.lit(i)) for i in (1, 2))
    both = F.zip_with(letters, texts, lambda a, b: F.struct(F.upper(a).alias("letter"), names.normal(b).alias("species")))
    return F.coalesce(F.filter(both, lambda o: o["species"].isNotNull()), F.array().cast("array<struct<letter:string,species:string>>"))


def option_named(found: Column, letter: Column) -> Column:
    """The species of the last option with that letter, null without one."""
    return F.try_element_at(F.filter(found, lambda o: o["letter"] == letter)["species"], F.lit(-1))


def resolve_species(question: Column, output: Column, names: ClassNames) -> Column:
    """The class an output means: by its first option's letter, by its whole answer, else by the first alias that stands in it; null if none."""
    answer = answer_any_case(output)
    by_letter = option_named(options(question, names), F.upper(F.regexp_extract(answer, OPTION_NAMED, 1)))
    return F.coalesce(by_letter, names.normal(answer), names.held(answer))


def option_lines(names: list[str]) -> str:
    """The lines "(A) name", lettered in order."""
    return "\n".join(f"({chr(ord('A') + i)}) {name}" for i, name in enumerate(names))


def correct_label(name: Column, names: list[str]) -> Column:
    """"(X) name" with the letter of the first option of that name; a name that is no option stands alone."""
    at = F.array_position(F.array(*(F.lit(n) for n in names)), name)
    return F.when(at > 0, F.concat(F.lit("("), F.char(at + 64), F.lit(") "), name)).otherwise(name)


def evidence_line(item: Column) -> Column:
    """"name: reason" of an evidence object (name, reason), the name alone without a reason."""
    name = F.coalesce(item["name"], F.lit(""))
    return F.when(F.coalesce(item["reason"], F.lit("")) == "", name).otherwise(F.concat(name, F.lit(": "), item["reason"]))


def trace(evidence: Column, supporting: Column, exclusion: Column, uncertainty: Column, summary: Column) -> Column:
    """The tagged text of an annotation; ``evidence`` is a list of lines, nulls left out. Without supporting text the middle part is empty."""
    nothing = lambda c: F.coalesce(c, F.lit(""))
    lines = F.array_join(F.transform(F.filter(F.coalesce(evidence, F.array().cast("array<string>")), lambda e: e.isNotNull()), lambda e: F.concat(F.lit("- "), e)), "\n")
    think = F.when(lines == "", F.lit("Observations: (none)")).otherwise(F.concat(F.lit("Observations:\n"), lines))
    middle = F.concat(F.lit("Supporting Reasoning: "), supporting, F.lit("\n\nExclusion/Counterfactual: "), nothing(exclusion), F.lit("\n\nUncertainty: "), nothing(uncertainty))
    rethink = F.when(nothing(supporting) == "", F.lit("")).otherwise(middle)
    return F.concat(F.lit("<think>"), think, F.lit("</think>\n\n<rethink>"), rethink, F.lit("</rethink><answer>"), nothing(summary), F.lit("</answer>"))


def clean_json_fence(c: Column) -> Column:
    """JSON text without code fences, en dashes as hyphens."""
    return strip(F.replace(F.regexp_replace(c, r"(?m)^\s*```(?:json)?\s*$", ""), F.lit("–"), F.lit("-")))


def json_in_text(c: Column) -> Column:
    """The JSON in free text as VARIANT: that of the first fenced block, else from the first ``{`` to the last ``}``, else the whole; null if that is no JSON."""
    fenced, braced = F.regexp_extract(c, r"(?s)```json(.*?)```", 1), F.regexp_extract(c, r"(?s)\{.*\}", 0)
    text = F.when(c.rlike(r"(?s)```json.*?```"), fenced).when(braced != "", braced).otherwise(c)
    return F.try_parse_json(F.replace(strip(text), F.lit("–"), F.lit("-")))


def judge_scores(c: Column) -> Column:
    """struct<think, rethink> of a judge's answer: the shortest first ``{...}``; without one, or where it is no JSON, both are 0."""
    found = F.from_json(F.regexp_extract(c, r"(?s)\{.*?\}", 0), "R_think double, R_rethink double")
    return F.struct(F.coalesce(found["R_think"], F.lit(0.0)).alias("think"), F.coalesce(found["R_rethink"], F.lit(0.0)).alias("rethink"))


def reward_mix(think: Column, rethink: Column, think_weight: float = 0.5, rethink_weight: float = 0.5) -> Column:
    """Weighted sum of two scores, each brought into [0, 1]; null scores count 0."""
    clamp = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return think_weight * clamp(think) + rethink_weight * clamp(rethink)


def frame_file(index: Column, ending: str = ".jpg") -> Column:
    """Zero-padded to six digits; longer numbers stay whole."""
    return F.concat(F.format_string("%06d", index), F.lit(ending))


def duration(seconds: Column) -> Column:
    """Seconds as ``12s``, ``3m 5s`` or ``2h 7m``."""
    s = seconds.cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def metric_text(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("N/A")).otherwise(F.format_string("%.3f", c))
