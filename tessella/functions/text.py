"""String functions: answers, prompts, paths and formats, all Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where an answer stands in a response.
ANSWER_TAG = r"(?s)<answer>(.*?)</answer>"
BOXED = r"(?s)\\boxed\{(.*?)\}"

#: Templates of what a judge is asked; each is a parameter of the evaluation.  The fields are in braces.
CHOICE_TEMPLATE = """Below are a multiple-choice question, its options and the answer that a model wrote.
Reply with the letter of the option that the answer means, and with nothing else.

Question: {question}
Options: {options}
Model answer: {model_answer}"""
OPEN_TEMPLATE = """Below are a question and the response that a model wrote.
Reply with the final answer that the response gives, as a word or a short phrase of at most five words, and with nothing else.

Question: {question}
Model response: {model_response}"""
JUDGE_TEMPLATE = """Below are a question about an image, the true answer and a model's answer.
Reply <correct> if the model's answer means the same as the true one. Reply <wrong> if it doesn't, or if you can't tell.

Question: {question}
True answer: {gt_answer}
Model answer: {model_answer}"""
THINK_PROMPT = "Think about the question first, between <think> and </think>. Then give the answer between <answer> and </answer>."


#: White space.
WHITE = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """without white space at both ends, in time linear in the text (``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(WHITE))


def last_match(c: Column, pattern: str, close: str) -> Column:
    """The last match's group 1, stripped; null where nothing matches.

    What follows the last ``close`` matches nothing and is cut off first: each
    opening before it then finds an end, so many unclosed ones don't each search
    the rest of the text.
    """
    open_end = F.substring_index(c, close, -1)
    return strip(F.try_element_at(F.regexp_extract_all(F.left(c, F.char_length(c) - F.char_length(open_end)), F.lit(pattern), F.lit(1)), F.lit(-1)))


def rule_answer(response: Column) -> Column:
    """the last tagged answer, else the whole response; then the last boxed part of that, else all of it."""
    tagged = F.coalesce(last_match(response, ANSWER_TAG, "</answer>"), response)
    return F.coalesce(last_match(tagged, BOXED, "}"), tagged)


def left_crop(c: Column, most: int = 1000) -> Column:
    """the last ``most`` characters of a longer text, marked as cropped."""
    return F.when(F.char_length(c) > most, F.concat(F.lit("[cropped] ... "), F.right(c, F.lit(most)))).otherwise(c)


def has_options(options: Column) -> Column:
    """Whether a question is multiple choice: null and empty options are none."""
    return F.coalesce(options != "", F.lit(False))


def prompt(question: Column, options: Column) -> Column:
    """The question, and its options on the next line if it has any."""
    return F.when(has_options(options), F.concat(question, F.lit("\n"), options)).otherwise(question)


def filled(template: str, **fields: Column) -> Column:
    """a template with its {fields} replaced in one pass; a field's own braces stay as they are."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m[1] in fields:
            parts += [F.lit(template[at : m.start()]), F.coalesce(fields[m[1]].cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def verdict(c: Column, strict: bool = False) -> Column:
    """whether a judge's reply says correct.  Loosely it need only contain the word (so "incorrect" does); strictly the tag decides."""
    if strict:
        return F.regexp_extract(F.lower(c), "<(correct|wrong)>", 1) == "correct"
    return F.contains(F.lower(c), F.lit("correct"))


def joined_path(root: Column, path: Column) -> Column:
    """A path under a root; an absolute path stands by itself."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), path))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """the extension with its dot, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def integer_stem(path: Column) -> Column:
    """the file's stem as an integer, null if it isn't one."""
    return F.when(stem(path).rlike(r"^[+-]?\d+$"), stem(path).try_cast("long"))


def capitalised(c: Column) -> Column:
    """F16: the first letter upper-cased, the rest lower-cased."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def data_url(content: Column, mime: str = "image/jpeg") -> Column:
    """Bytes as a data URL, on one line."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def data_url_bytes(url: Column) -> Column:
    """The bytes of an image data URL, null for any other URL."""
    return F.when(url.startswith("data:image") & F.contains(url, F.lit("base64,")), F.try_to_binary(F.substring_index(url, "base64,", -1), F.lit("base64")))


def percent(c: Column) -> Column:
    """a share in percent with one decimal, as text."""
    return F.format_string("%.1f", F.bround(c * 100, 1))


def spread(mean: Column, std: Column, trials: Column) -> Column:
    """mean and deviation in percent, and the number of trials; null without a mean."""
    return F.when(mean.isNotNull(), F.format_string("%s±%s @%d", percent(mean), percent(std), trials))


def image_candidates(path: Column) -> Column:
    """The path itself, then its stem with each usual image extension."""
    #: The extensions, in the order they are tried.
    usual = [".jpg", ".jpeg", ".png", ".bmp", ".tiff"]
    base = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    return F.concat(F.array(path), *[F.array(F.concat(base, F.lit(e))) for e in usual])


def matches_glob(c: Column, part: str) -> Column:
    """whether a name contains a part, as ``*part*`` does."""
    return F.contains(c, F.lit(part))


def wrapped(c: Column, width: int = 80) -> Column:
    """a text broken into lines of at most ``width`` at spaces; ``N/A`` if there is none."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.rtrim(F.regexp_replace(F.concat(x, F.lit(" ")), rf"(.{{1,{width}}})(?: +|$)", "$1\n"), F.lit("\n ")))
    return F.when(F.coalesce(strip(c), F.lit("")) == "", F.lit("N/A")).otherwise(F.array_join(lines, "\n"))
