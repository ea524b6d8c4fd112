"""String functions of the logic-pair corpora, Column to Column; all stay in the JVM.

Null in, null out, unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PUNCTUATION, SPACES

# ---- fixed values
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
NEGATING_PREFIXES = ["in", "un", "ir"]
RELATION_NAMES = {
    "full-affirmative": ["full-affirmative", "fullaff", "full_affirmative"],
    "partial-affirmative": ["partial-affirmative", "partialaff"],
    "full-negative": ["full-negative", "fullneg"],
    "partial-negative": ["partial-negative", "partialneg"],
}
ANSWER_PREFIXES = ["assistant\n\n", "assistant\n", "assistant:", "model\n\n", "model\n", "Paraphrase:", "Output:", "Here", "Sure", "Of course"]
PREAMBLES = ["here is", "sure,", "i ", "as ", "the paraphrase"]
SENTINELS = ["[rule_did_not_fire", "[rule_not_implemented", "[parse_failed", "[generation_failed"]
# ---- end of fixed values


def words(text: Column) -> Column:
    """Split at ASCII white space, without empty words."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def without_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION, "")


def without_sense(concept: Column) -> Column:
    return F.regexp_replace(concept, r"-[0-9]+$", "")


def frame(concept: Column) -> Column:
    """(lemma, sense) of a numbered frame; nulls for other concepts."""
    part = lambda k: F.nullif(F.regexp_extract(concept, r"^(.+?)-([0-9]+)$", k), F.lit(""))
    return F.struct(part(1).alias("lemma"), part(2).alias("sense"))


def is_event_frame(concept: Column) -> Column:
    return concept.rlike(r"^[a-z][a-z0-9_-]*-[0-9]{2,3}$")


def first_sense(graph_text: Column) -> Column:
    """Word senses made equal: ``/ word-03`` becomes ``/ word-01``."""
    return F.regexp_replace(graph_text, r"(/ [a-zA-Z0-9-]+)-[0-9]+", "$1-01")


def unlabelled(graph_text: Column) -> Column:
    """Role names made equal, inverse ones apart."""
    marked = F.regexp_replace(graph_text, r":[0-9a-zA-Z]*-of", "\x01")
    return F.replace(F.regexp_replace(marked, r":[0-9a-zA-Z]+", ":label"), F.lit("\x01"), F.lit(":label-of"))


def without_alignments(graph_text: Column) -> Column:
    return F.regexp_replace(graph_text, r"~e\.[0-9]+(?:,[0-9]+)*", "")


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"~[A-Z$]+", "")


def stemmed_line(text: Column) -> Column:
    """The first three characters of each word; roles and ++words++ stay."""
    whole = lambda w: w.startswith(":") | (w.startswith("++") & w.endswith("++"))
    return F.array_join(F.transform(words(text), lambda w: F.when(whole(w), w).otherwise(F.substring(w, 1, 3))), " ")


def with_positions(text: Column) -> Column:
    """Each word with its position behind it."""
    return F.array_join(F.transform(words(text), lambda w, i: F.concat(w, F.lit("_"), i.cast("string"))), " ")


def joined_pairs(text: Column) -> Column:
    """``a b c d`` as ``a-b c-d``; a word left over goes."""
    ws = words(text)
    places = F.when(F.size(ws) > 1, F.sequence(F.lit(0), F.size(ws) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: F.concat(F.get(ws, i), F.lit("-"), F.get(ws, i + 1))), " ")


def swapped_pairs(text: Column) -> Column:
    """``a-b`` as ``b-a``, for each word of one dash."""
    side = lambda w, k: F.get(F.split(w, "-"), F.lit(k))
    return F.array_join(F.transform(words(text), lambda w: F.concat(side(w, 1), F.lit("-"), side(w, 0))), " ")


def kept_words(text: Column, stop: list[str]) -> Column:
    """[(word, pos)] of the words that are no stop words, with their original positions."""
    numbered = F.transform(words(text), lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    return F.filter(numbered, lambda x: ~x["word"].isin(*stop))


def remapped(positions: Column, kept: Column) -> Column:
    """Positions among kept words as positions in the original line."""
    return F.transform(positions, lambda p: F.get(kept, p)["pos"])


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading characters two strings share."""
    n = F.least(F.length(a), F.length(b))
    fits = F.filter(F.sequence(F.lit(0), n), lambda k: F.substring(a, 1, k) == F.substring(b, 1, k))
    return F.array_max(fits)


def keyword_place(tokens: Column, keyword: str) -> Column:
    """Index of a keyword among tokens; of one of several words, the tokens before it; -1 if absent."""
    if " " not in keyword:
        return (F.array_position(tokens, keyword) - 1).cast("int")
    text = F.array_join(tokens, " ")
    at = F.instr(text, keyword)
    return F.when(at == 0, -1).otherwise(F.size(words(F.substring(text, F.lit(1), at - 1))))


def candidates(word: Column) -> Column:
    """What a word may stand as in a graph: itself, a month's or number's digits, and itself without a negating prefix."""
    table = {**{m: str(k + 1) for k, m in enumerate(MONTHS)}, **{m[:3]: str(k + 1) for k, m in enumerate(MONTHS)}, **{w: str(k) for k, w in enumerate(NUMBER_WORDS)}}
    w = F.lower(word)
    digits = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[w]
    bare = F.when(F.substring(w, 1, 2).isin(*NEGATING_PREFIXES), F.substring(w, 3, 1_000_000))
    return F.filter(F.array(w, digits, bare), lambda x: x.isNotNull())


def summary_lines(text: Column) -> Column:
    return F.replace(text, F.lit(" . "), F.lit(" .\n"))


def relation_name(name: Column) -> Column:
    """One spelling of a document relation, with its colon."""
    bare, out = F.regexp_replace(name, "^:+", ""), None
    for one, spellings in RELATION_NAMES.items():
        out = F.when(bare.isin(*spellings), f":{one}") if out is None else out.when(bare.isin(*spellings), f":{one}")
    return out.otherwise(F.concat(F.lit(":"), bare))


def percent(part: Column, whole: Column) -> Column:
    """Integer percent, rounded down; 0 of nothing."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.floor(part * 100 / whole))


def percent_text(value: Column) -> Column:
    """A share as text with one decimal."""
    return F.format_string("%.1f%%", F.round(value * 100, 1))


def choice_text(question: Column, ending: Column) -> Column:
    """A cloze question takes the ending at every underscore; others get it behind them."""
    return F.when(F.instr(question, "_") > 0, F.replace(question, F.lit("_"), ending)).otherwise(F.concat(question, F.lit(" "), ending))


def answer_index(answer: Column) -> Column:
    """A-D or 1-4 as 0..3, other answers null."""
    return F.when(answer.rlike("^[A-D]$"), F.ascii(answer) - 65).when(answer.rlike("^[1-4]$"), F.ascii(answer) - 49)


def mention_context(sentence: Column, mention: Column) -> Column:
    """(left, right) of a mention's first place, lower-cased; the whole sentence on both sides if it is absent."""
    at = F.instr(F.lower(sentence), F.lower(mention))
    left = F.when(at > 0, F.substring(F.lower(sentence), F.lit(1), at - 1)).otherwise(F.lower(sentence))
    right = F.when(at > 0, F.substring(F.lower(sentence), at + F.length(mention), F.length(sentence))).otherwise(F.lower(sentence))
    return F.struct(left.alias("left"), right.alias("right"))


def completion_head(text: Column) -> Column:
    """The first line of a completion, 200 characters at most (the size of the field, not a limit on rows)."""
    return F.substring(F.substring_index(text, "\n", 1), 1, 200)


def cleaned_completion(text: Column) -> Column:
    """A model's answer without role markers, later paragraphs, quotes and preamble; null below four characters."""
    bare = lambda t, p: F.trim(F.regexp_replace(t.substr(F.length(p) + 1, F.length(t)), "^[:\n ]+", ""))
    t = F.aggregate(F.array(*map(F.lit, ANSWER_PREFIXES)), F.trim(text), lambda t, p: F.when(t.startswith(p), bare(t, p)).otherwise(t))
    t = F.trim(F.substring_index(t, "\n\n", 1))
    t = F.regexp_replace(F.regexp_replace(t, '^"+|"+$', ""), "^'+|'+$", "")

    def without_preamble(t: Column) -> Column:
        talk = F.exists(F.array(*map(F.lit, PREAMBLES)), lambda p: F.lower(t).startswith(p))
        told = F.when(talk & (F.instr(t, ":") > 0), F.trim(t.substr(F.instr(t, ":") + 1, F.length(t)))).otherwise(t)
        return F.when(F.length(told) >= 4, told)

    return F.get(F.transform(F.array(t), without_preamble), F.lit(0))


def is_real_output(output: Column, status: Column) -> Column:
    """Whether a candidate's output is text and no status note; a retried one is none here."""
    note = F.lit(False)
    for s in SENTINELS:
        note = note | output.startswith(s)
    return output.isNotNull() & ~F.coalesce(note, F.lit(False)) & F.coalesce(status, F.lit("ok")).isin("ok", "")


def status_category(status: Column) -> Column:
    s = F.coalesce(status, F.lit("ok"))
    return F.when(s.startswith("rule_did_not_fire") | s.startswith("rule_not_implemented"), "rule_did_not_fire").when(s.startswith("self_check_failed"), "self_check_failed").when(s.isin("ok", "ok_retry"), "ok").otherwise("other")


def is_clean_tuple(text: Column) -> Column:
    """Parts between semicolons, parentheses aside: none is empty, begins with a digit or holds a place or time label."""
    parts = F.transform(F.split(F.regexp_replace(text, "[()]", ""), ";"), lambda p: F.trim(p))
    return F.forall(parts, lambda p: (p != "") & ~p.rlike("^[0-9]") & ~p.contains("L:") & ~p.contains("T:"))


def verbalized(lhs: Column, lhs_not: Column, rhs: Column, rhs_not: Column) -> Column:
    """An implication as a sentence; the side's first word decides between ``it`` and none."""
    no = lambda c: F.when(c, "not ").otherwise("")
    return F.concat(F.lit("If it is "), no(lhs_not), lhs, F.lit(", then it will be "), no(rhs_not), rhs, F.lit("."))


def spliced(context: Column, old: Column, new: Column) -> Column:
    """The context with its first ``old`` replaced by ``new``; else the sentence that shares over 0.8 of
    ``old``'s words is; else null."""
    at = F.instr(context, old)
    exact = F.concat(F.substring(context, F.lit(1), at - 1), new, F.substring(context, at + F.length(old), F.length(context)))
    pieces = F.split(context, r"(?<=[.!?])[ \t\n\r\f\x0B]+")
    target = F.array_distinct(words(F.lower(old)))
    near = lambda p: F.size(F.array_intersect(F.array_distinct(words(F.lower(p))), target)) > F.size(target) * 0.8
    first = F.get(F.filter(pieces, near), F.lit(0))
    return F.when((at > 0) & (old != ""), exact).when(first.isNotNull(), F.array_join(F.transform(pieces, lambda p: F.when(p == first, new).otherwise(p)), " "))
