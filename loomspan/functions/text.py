"""Scalar expressions over text columns; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
LINE_BREAKS = "[\n\u000b\u000c\u001c-\u001e\u0085  ]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def clean_text(content: Column, max_chars: int) -> Column:
    """Bytes to text: malformed UTF-8 dropped, line ends unified, cut to ``max_chars``."""
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    return F.left(F.regexp_replace(text, "\r\n?", "\n"), F.lit(max_chars))


def split_lines(text: Column) -> Column:
    """Array of lines at all Unicode line breaks; a final empty line is no line."""
    parts = F.split(text, LINE_BREAKS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def extension(path: Column) -> Column:
    """Lower-cased; a name's leading dots begin no extension."""
    return F.lower(F.regexp_extract(path, r"[^./](\.[^./]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def leaf(name: Column) -> Column:
    return F.element_at(F.split(name, "[.]"), -1)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def capped_json(value: Column, max_chars: int = 4000) -> Column:
    out = F.to_json(value)
    return F.when(F.length(out) > max_chars, F.concat(F.left(out, F.lit(max_chars)), F.lit("..."))).otherwise(out)


def clean_sql_name(c: Column) -> Column:
    """Trim, strip commas, then one layer each of brackets, back-ticks and quotes."""
    out = F.btrim(strip(c), F.lit(","))
    for pair in (r"^\[(.*)\]$", r"^`(.*)`$", r'^"(.*)"$', r"^'(.*)'$"):
        out = F.regexp_replace(out, pair, "$1")
    return out


def weighted_limit(weight: Column, base: int) -> Column:
    """Half-to-even rounding of base * weight."""
    return F.bround(F.lit(max(1, base)) * weight).cast("int")


def split_budget(total: Column, buckets: Column, index: Column) -> Column:
    """Share of bucket ``index`` (from 0): equal parts, the remainder to the first ones."""
    return (F.floor(total / buckets) + F.when(index < total % buckets, 1).otherwise(0)).cast("int")


def citations(text: Column, most: Column) -> Column:
    """Sorted distinct [n] with 1 <= n <= most."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= most))))


def ensure_citations(text: Column, sources: Column) -> Column:
    """Text as it is if it cites a valid source, else with up to three citations added."""
    added = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(sources, F.lit(3)))), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), " ")
    plain = (sources <= 0) | (F.size(citations(text, sources)) > 0)
    return F.when(plain, text).otherwise(F.concat(F.rtrim(text, F.lit(SPACE)), F.lit("\n\nCitations: "), added))


def no_source_answer(intent: Column, stores: Column) -> Column:
    return F.concat(
        F.lit("No indexed code or context was found for the selected repo store(s): "), F.array_join(stores, ", "),
        F.lit(". Run the embedding job for that repo and ask again. Detected intent: "), intent, F.lit("."),
    )


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def usage_tokens(body: Column) -> dict[str, Column]:
    """Prompt, completion and total tokens of a JSON call body: the first spelling present counts, negatives are 0."""
    def first(*paths: str) -> Column:
        return F.greatest(F.lit(0), F.coalesce(*[F.get_json_object(body, p).try_cast("bigint") for p in paths], F.lit(0)))

    prompt = first("$.usage.prompt_tokens", "$.usage.input_tokens", "$.usage.prompt_eval_count", "$.prompt_eval_count")
    answer = first("$.usage.completion_tokens", "$.usage.output_tokens", "$.usage.eval_count", "$.eval_count")
    has = F.coalesce(*[F.get_json_object(body, f"$.usage.{k}") for k in ("prompt_tokens", "input_tokens", "completion_tokens", "output_tokens", "total_tokens")], F.get_json_object(body, "$.prompt_eval_count"), F.get_json_object(body, "$.eval_count")).isNotNull()
    total = F.coalesce(F.get_json_object(body, "$.usage.total_tokens").try_cast("bigint"), prompt + answer)
    return {"prompt_tokens": prompt, "completion_tokens": answer, "total_tokens": F.greatest(F.lit(0), total), "has_usage": has}


def json_segment(text: Column) -> Column:
    """The text itself if it is a JSON object, else its first balanced {...} outside strings, else null."""
    def state(at: Column, depth: Column, quoted: Column, escaped: Column, start: Column, stop: Column) -> Column:
        return F.struct(at.alias("at"), depth.alias("depth"), quoted.alias("quoted"), escaped.alias("escaped"), start.alias("start"), stop.alias("stop"))

    def step(s: Column, ch: Column) -> Column:
        at = s["at"] + 1
        inside = s["quoted"] & (s["depth"] > 0)
        quoted = F.when(s["depth"] == 0, False).when((ch == '"') & ~s["escaped"], ~s["quoted"]).otherwise(s["quoted"])
        escaped = inside & (ch == "\\") & ~s["escaped"]
        depth = F.when(inside, s["depth"]).when(ch == "{", s["depth"] + 1).when((ch == "}") & (s["depth"] > 0), s["depth"] - 1).otherwise(s["depth"])
        start = F.when((s["start"] == 0) & (depth == 1), at).otherwise(s["start"])
        stop = F.when((s["depth"] == 1) & (depth == 0), at).otherwise(s["stop"])
        return F.when(s["stop"] > 0, s).otherwise(state(at, depth, quoted, escaped, start, stop))

    blank = state(F.lit(0), F.lit(0), F.lit(False), F.lit(False), F.lit(0), F.lit(0))
    span = F.aggregate(F.split(text, ""), blank, step, lambda s: F.when(s["stop"] > 0, F.substring(text, s["start"], s["stop"] - s["start"] + 1)))
    whole = F.try_parse_json(text)
    return F.when(whole.isNotNull() & F.startswith(strip(text), F.lit("{")), text).otherwise(span)
