"""Text normalising, quality, titles and citations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ASCII punctuation signs.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PUNCT_CLASS = r"[!-/:-@\[-`{-~]"

#: Common English words that carry no topic.
STOP_WORDS = ("a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "can", "could", "do", "for", "from", "had", "has", "have", "he", "her", "his", "if", "in", "into", "is", "it", "its", "more", "most", "no", "not", "of", "on", "or", "other", "our", "she", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to", "was", "we", "were", "which", "while", "who", "will", "with", "would", "you")

#: Ligatures and marks that optical recognition leaves.
OCR_REPAIRS = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("[‐‑]", "-"), ("[“”]", '"'), ("[‘’]", "'"), ("([a-z])-\\n([a-z])", "$1$2"), ("­", ""))


def blank_collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def lower_each(text: Column) -> Column:
    """Lower case letter by letter, whatever stands beside it: a final sigma is one sigma, and no letter becomes two."""
    return F.lower(F.replace(F.replace(text, F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i")))


def upper_each(text: Column) -> Column:
    """Upper case letter by letter. What has no capital of one letter (such as ß) stays, so lengths and places stay."""
    one = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def soft_repair(text: Column) -> Column:
    """Puts the blanks back that extraction lost after signs and between glued words."""
    t = F.regexp_replace(text, r"([.!?;:])([a-zA-Z0-9])", "$1 $2")
    t = F.regexp_replace(t, r",([a-zA-Z0-9])", ", $1")
    t = F.regexp_replace(t, r"([a-z])([A-Z])", "$1 $2")
    return blank_collapsed(t)


def match_form(text: Column) -> Column:
    """For comparing quotes: lower case, no white space, no ASCII punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", ""), _PUNCT_CLASS, "")


def snake_case(text: Column) -> Column:
    """Lower case; runs of anything but letters and digits become one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def snake_case_strict(text: Column, aliases: dict[str, str] | None = None, generic: tuple[str, ...] = ("method", "approach", "model", "system", "data", "result", "analysis")) -> Column:
    """snake_case without stop words, by aliases; null for what is generic or shorter than three characters."""
    kept = F.array_join(F.filter(F.split(snake_case(text), "_"), lambda w: ~w.isin(*STOP_WORDS)), "_")
    for k, v in (aliases or {}).items():
        kept = F.when(kept == k, v).otherwise(kept)
    return F.when((F.length(kept) >= 3) & ~kept.isin(*generic), kept)


def ocr_repaired(text: Column) -> Column:
    for pattern, by in OCR_REPAIRS:
        text = F.regexp_replace(text, pattern, by)
    return text


def text_quality(text: Column) -> Column:
    """struct(score, label, whitespace_ratio, max_run, camel_rate, avg_word): penalties for lost blanks, glued words
    and odd word lengths, from 1 down to 0; below 20 characters a text is `short` with score 0.

    The text is split once: what is measured is bound to a name, as the one element of an array."""
    runs = F.transform(F.split(text, r"\s+"), F.length)
    measured = F.struct(F.length(text).alias("n"), runs.alias("runs"), F.regexp_count(text, F.lit("[a-z][A-Z]")).alias("camel"))

    def sums(m: Column) -> Column:
        letters = F.aggregate(m["runs"], F.lit(0), lambda a, k: a + k)  # all but white space
        words = F.size(F.filter(m["runs"], lambda k: k > 0))
        return F.struct(m["n"].alias("n"), F.try_divide(m["n"] - letters, m["n"]).alias("ws"), F.coalesce(F.array_max(m["runs"]), F.lit(0)).alias("run"), F.try_divide(m["camel"], m["n"]).alias("camel"), F.coalesce(F.try_divide(letters, words), F.lit(0.0)).alias("avg"))

    def rated(m: Column) -> Column:
        ws, run, camel, avg = m["ws"], m["run"], m["camel"], m["avg"]
        raw = F.lit(1.0) - F.when(ws < 0.10, 0.4).when(ws < 0.15, 0.2).otherwise(0.0) - F.when(run > 100, 0.3).when(run > 50, 0.15).otherwise(0.0) - F.when(camel > 0.10, 0.3).when(camel > 0.05, 0.15).otherwise(0.0) - F.when((avg < 3) | (avg > 12), 0.1).otherwise(0.0)
        short = F.coalesce(m["n"], F.lit(0)) < 20
        zero = lambda c, z: F.when(short, F.lit(z)).otherwise(c)
        score = zero(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3), 0.0)
        label = F.when(short, "short").when(score >= 0.7, "clean").when(ws < 0.10, "no_space").when((camel > 0.05) | (run > 50), "glued").otherwise("marginal")
        return F.struct(score.alias("score"), label.alias("label"), zero(F.bround(ws, 3), 0.0).alias("whitespace_ratio"), zero(run, 0).alias("max_run"), zero(F.bround(camel, 3), 0.0).alias("camel_rate"), zero(F.bround(avg, 1), 0.0).alias("avg_word"))

    return F.transform(F.transform(F.array(measured), sums), rated)[0]


def first_title(text: Column, least: int = 10, most: int = 200) -> Column:
    """The first line that can be a title: of fitting length, not only digits, not the head of a section."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 20), lambda s: F.trim(s))
    fits = F.filter(lines, lambda s: (F.length(s) >= least) & (F.length(s) <= most) & ~s.rlike(r"^[0-9.\s]+$") & ~F.lower(s).rlike(r"^(abstract|introduction|contents|references|doi|http|www)"))
    return F.get(fits, 0)


def heading_title(text: Column) -> Column:
    """The first Markdown heading that is more than a number, else the first fitting line."""
    heads = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s.rlike(r"^#{1,3} ") & ~s.rlike(r"^#{1,3} [0-9.]+$"))
    return F.coalesce(F.regexp_replace(F.get(heads, 0), r"^#{1,3} +", ""), first_title(text))


def is_placeholder_title(title: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return (t == "") | t.isin("unknown", "untitled", "none", "document") | t.rlike("^[0-9]+$")


def authors_in(text: Column) -> Column:
    """The line after "Authors:" or "By", split at commas and "and"."""
    line = F.regexp_extract(text, r"(?im)^(?:authors?:|by) +(.+)$", 1)
    return F.filter(F.transform(F.split(line, r",| and "), lambda s: F.trim(s)), lambda a: a != "")


def source_kind(text: Column) -> Column:
    """paper, code, textbook or document, by signs in the first thousand characters."""
    t = F.lower(F.substring(text, 1, 1000))
    return F.when(t.rlike(r"abstract|doi:|arxiv"), "paper").when(t.rlike(r"\bdef |\bclass |import |function\("), "code").when(t.rlike(r"chapter [0-9]|exercises"), "textbook").otherwise("document")


def inline_citation(authors: Column, year: Column, page: Column) -> Column:
    """(Name et al., year, p. n) with what is known."""
    who = F.when(F.size(authors) > 1, F.concat(F.get(authors, 0), F.lit(" et al."))).otherwise(F.coalesce(F.get(authors, 0), F.lit("Unknown")))
    at = F.when(page >= 1, F.concat(F.lit("p. "), page.cast("string")))
    return F.concat(F.lit("("), F.concat_ws(", ", who, F.coalesce(year.cast("string"), F.lit("n.d.")), at), F.lit(")"))


def full_citation(authors: Column, year: Column, title: Column, venue: Column, doi: Column) -> Column:
    return F.concat_ws(". ", F.when(F.size(authors) > 0, F.array_join(authors, ", ")), F.concat(F.lit("("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")")), title, venue, F.concat(F.lit("doi:"), doi))


def audit_citation(passage: Column, span: Column, score: Column) -> Column:
    return F.format_string("passage=%s span=%s entailment=%.3f", passage.cast("string"), span.cast("string"), score)


def permalink(org: Column, repo: Column, commit: Column, path: Column, start: Column, end: Column) -> Column:
    return F.format_string("https://github.com/%s/%s/blob/%s/%s#L%d-L%d", org, repo, F.coalesce(commit, F.lit("HEAD")), path, start, end)


def short_ref(repo: Column, path: Column, line: Column) -> Column:
    return F.format_string("%s/%s:%d", repo, F.element_at(F.split(path, "/"), -1), line)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def key_terms(text: Column, k: int = 8, longer_than: int = 3) -> Column:
    """The k most frequent words that are no stop words; ties by first mention."""
    w = F.filter(words_of(text), lambda x: (F.length(x) > longer_than) & ~x.isin(*STOP_WORDS))
    ranked = F.array_sort(F.transform(F.array_distinct(w), lambda x: F.struct((-F.size(F.filter(w, lambda y: y == x))).alias("n"), F.array_position(w, x).alias("at"), x.alias("w"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["w"])


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("bigint")


def extraction_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Prices are for a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def searchable(*parts: Column) -> Column:
    """The parts that are there, one below the other."""
    return F.concat_ws("\n", *(F.when(F.trim(p) != "", p) for p in parts))


def truncated(text: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def json_in(reply: Column) -> Column:
    """The JSON in a chatty reply, as a variant: all of it, else a fenced block, else from the first bracket to the
    last; null if none parses."""
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    inner = F.nullif(F.regexp_extract(reply, r"(?s)([\[{].*[\]}])", 1), F.lit(""))
    return F.coalesce(F.try_parse_json(reply), F.try_parse_json(fenced), F.try_parse_json(inner))
