"""Content blocks: questions with options, blanks, true/false, specifications, forms, definitions, equations, prose.

Each detector gives a STRUCT<content_type, nl, data, confidence>, or null where the block isn't of its kind; data is a JSON
string. Everything is JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import TICK, strip

# The shapes of the kinds of block.
OPTION = r"^(?:\(?([A-Ha-h1-8])[.)]\s*|([A-Ha-h1-8])\.\s*)(.+?)(?:\s*[✓✔☑☒◉]|\s*\[x\]|\s*\[X\])?$"
QUESTION = r"(?i)^(Q(?:uestion)?\.?\s*\d+\.?\s*|(?:\d+[.)])\s*)(.+?[?:])\s*$"
BLANK = r"(?i)_{3,}|\.{4,}|\[_+\]|\[blank\]|\(_+\)|\[answer\]"
ANSWER = r"(?i)\b(?:answer|ans|solution|sol)[\s.:]+([^\n]{1,100})"
TRUE_FALSE, YES, NO = r"(?iU)\b(True|False|T\b|F\b)\b", "[✓✔☑]", "[✗☒✘×]"
LABEL_VALUE = r"(?m)^([A-Za-z][A-Za-z0-9\s/\-]{2,40}?)\s*[:\|]\s*(.{1,200}?)(?:\s*$|\s{3,})"
DOTTED = r"(?m)^([A-Za-z][A-Za-z0-9\s/\-]{2,40}?)\s*[.·]{3,}\s*(.{1,200}?)$"
DEFINITION = r"^([A-Z][A-Za-z\s\-/]{1,60}?)(?:\s*[:\-—]\s*|\s{2,})([A-Z].{10,300}?)(?:\.|$)"
SPECIFICATION = r"(?m)^([A-Za-z][A-Za-z0-9\s/\-\(\)]{2,50}?)\s*[:\-]\s*(\d[\d.,/\s]*(?:A|V|W|kW|kV|Hz|rpm|in|mm|kg|lb|%|°[CF])[^\n]*)"
EQUATION = r"(?i)(?:[A-Za-z]\s*=\s*[A-Za-z0-9\s\+\-\*/\^\(\)\[\]\{\}\.\,]+|\b(?:Formula|Equation|Where|Given)\b.{1,200})"
MOST_DEFINITION_LINES, MOST_EQUATION = 10, 500


def _found(kind: str, nl: Column, data: Column, confidence: Column | float, when: Column) -> Column:
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.when(when, F.struct(F.lit(kind).alias("content_type"), nl.alias("nl"), data.alias("data"), c.cast("double").alias("confidence")))


def _lines(t: Column) -> Column:
    return F.transform(F.split(strip(t), "\n"), strip)


def _last_wins(pairs: Column) -> Column:
    """A map whose keys are in order of first sight and have the last value seen."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def _joined(m: Column, sep: str, join: str) -> Column:
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(sep), e["value"])), join)


def mcq(t: Column) -> Column:
    lines = _lines(t)
    is_option = lambda s: s.rlike(OPTION)
    asked = lambda s: strip(F.regexp_extract(s, QUESTION, 2))
    candidates = F.filter(
        F.transform(lines, lambda s, i: F.when(s.rlike(QUESTION), asked(s)).when((s != "") & ~is_option(s) & F.coalesce(is_option(F.get(lines, i + 1)), F.lit(False)), s)), lambda s: s.isNotNull()
    )
    question = F.coalesce(F.get(candidates, F.lit(0)), F.get(lines, F.lit(0)))
    options = F.filter(lines, is_option)
    label = lambda s: F.upper(F.concat(F.regexp_extract(s, OPTION, 1), F.regexp_extract(s, OPTION, 2)))
    body = lambda s: strip(F.regexp_extract(s, OPTION, 3))
    pairs = _last_wins(F.transform(options, lambda s: F.struct(label(s).alias("k"), body(s).alias("v"))))
    ticked = F.filter(options, lambda s: s.rlike(TICK))
    right = F.when(F.size(ticked) > 0, F.element_at(ticked, -1))
    listed = F.array_join(F.transform(F.map_entries(pairs), lambda e: F.concat(F.lit("("), e["key"], F.lit(") "), e["value"])), "; ")
    nl = F.when(right.isNotNull(), F.concat(F.lit("The correct answer to '"), question, F.lit("' is "), body(right), F.lit(" (Option "), label(right), F.lit(")."))).otherwise(F.concat(F.lit("Question: "), question, F.lit(" Options: "), listed, F.lit(".")))
    data = F.to_json(F.struct(question.alias("question"), pairs.alias("options"), label(right).alias("correct_option"), body(right).alias("correct_answer"), F.size(pairs).alias("num_options")))
    return _found("mcq", nl, data, F.when(right.isNotNull(), 0.95).otherwise(0.75), (F.size(lines) >= 3) & (F.size(options) >= 2) & (F.size(pairs) >= 2))


def fill_blank(t: Column) -> Column:
    n = F.regexp_count(t, F.lit(BLANK))
    answer = F.nullif(strip(F.regexp_extract(t, ANSWER, 1)), F.lit(""))
    blanked = F.regexp_replace(t, BLANK, "_____")
    template = strip(F.when(answer.isNotNull(), F.substring(blanked, F.lit(1), F.regexp_instr(t, F.lit(ANSWER)) - 1)).otherwise(blanked))
    at = F.instr(template, "_____")
    filled = strip(F.when(at > 0, F.concat(F.substring(template, F.lit(1), at - 1), answer, F.substring(template, at + 5, F.length(template)))).otherwise(template))
    nl = F.when(answer.isNotNull(), F.when(filled.endswith("."), filled).otherwise(F.concat(filled, F.lit(".")))).otherwise(F.concat(F.lit("Fill in the blank: "), template))
    data = F.to_json(F.struct(template.alias("question_template"), n.alias("blank_count"), answer.alias("answer")))
    return _found("fill_blank", nl, data, F.when(answer.isNotNull(), 0.9).otherwise(0.7), n > 0)


def true_false(t: Column, strict: bool = False) -> Column:
    """As loose as its pattern: prose with the word true matches. strict: the word must end its line."""
    lines = F.filter(_lines(t), lambda s: s != "")
    line = F.get(F.filter(lines, lambda s: s.rlike(r"(?i)\b(True|False|T|F)\b\s*[✓✔☑✗☒✘×]?$" if strict else TRUE_FALSE)), F.lit(0))
    stated = F.lower(F.regexp_extract(line, TRUE_FALSE, 1))
    correct = F.when(line.rlike(YES), stated).when(line.rlike(NO), F.when(stated == "true", "false").otherwise("true"))
    statement = F.when(F.size(lines) > 1, F.get(lines, F.lit(0))).otherwise(strip(t))
    nl = F.when(correct.isNotNull(), F.concat(F.lit("The statement '"), statement, F.lit("' is "), correct, F.lit("."))).otherwise(F.concat(F.lit("True/False: "), statement))
    return _found("true_false", nl, F.to_json(F.struct(statement.alias("statement"), correct.alias("correct_value"))), 0.85, line.isNotNull())


def _pairs(t: Column, pattern: str, trim: str) -> Column:
    part = lambda k: F.regexp_extract_all(t, F.lit(pattern), F.lit(k))
    return F.zip_with(part(1), part(2), lambda k, v: F.struct(F.regexp_replace(strip(k), trim, "").alias("k"), strip(v).alias("v")))


def form_fields(t: Column) -> Column:
    both = F.concat(_pairs(t, LABEL_VALUE, r"[.:]+$"), _pairs(t, DOTTED, r"[.:]+$"))
    bars = lambda c: F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit("")))
    fields = _last_wins(F.filter(both, lambda p: (F.length(p["k"]) >= 2) & (F.length(p["v"]) >= 1) & (bars(p["k"]) == 0) & (bars(p["v"]) <= 1)))
    return _found("form_field", F.concat(_joined(fields, ": ", "; "), F.lit(".")), F.to_json(F.struct(fields.alias("fields"))), 0.8, F.size(fields) >= 2)


def definition(t: Column) -> Column:
    lines = _lines(t)
    line = F.get(F.filter(lines, lambda s: s.rlike(DEFINITION)), F.lit(0))
    term, meaning = F.regexp_replace(strip(F.regexp_extract(line, DEFINITION, 1)), "[:—-]+$", ""), strip(F.regexp_extract(line, DEFINITION, 2))
    return _found("definition", F.concat(term, F.lit(" means "), meaning), F.to_json(F.struct(term.alias("term"), meaning.alias("definition"))), 0.8, (F.size(lines) <= MOST_DEFINITION_LINES) & line.isNotNull())


def specification(t: Column) -> Column:
    specs = _last_wins(_pairs(t, SPECIFICATION, "[:-]+$"))
    return _found("specification", F.concat(F.lit("Technical specifications: "), _joined(specs, "=", "; "), F.lit(".")), F.to_json(F.struct(specs.alias("specs"))), 0.85, F.size(specs) >= 2)


def equation(t: Column) -> Column:
    eq = strip(F.regexp_extract(t, EQUATION, 0))
    return _found("equation", F.concat(F.lit("Equation: "), eq), F.to_json(F.struct(eq.alias("equation"))), 0.75, t.rlike(EQUATION) & (F.length(strip(t)) <= MOST_EQUATION))


def paragraph(t: Column) -> Column:
    s = strip(t)
    nl = F.when(F.length(s) >= 300, F.concat(F.substring(s, 1, 300), F.lit("..."))).otherwise(s)
    return _found("paragraph", nl, F.lit("{}"), 0.5, F.lit(True))


def classify(t: Column, section: Column | None = None, strict: bool = False) -> Column:
    """The first detector's finding of 0.7 or more, else a paragraph; a section title goes before the sentence."""
    found = [mcq(t), fill_blank(t), true_false(t, strict), specification(t), form_fields(t), definition(t), equation(t)]
    best = F.coalesce(*[F.when(f["confidence"] >= 0.7, f) for f in found], paragraph(t))
    if section is None:
        return best
    prefixed = F.when((best["content_type"] != "paragraph") & (F.coalesce(section, F.lit("")) != "") & ~F.contains(best["nl"], section), F.concat(F.lit("["), section, F.lit("] "), best["nl"]))
    return best.withField("nl", F.coalesce(prefixed, best["nl"]))
