"""Token, phrase and boundary matching as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no weight in matching.
STOPWORDS = ["a", "an", "and", "as", "be", "by", "for", "from", "in", "is", "it", "of", "or", "the", "to", "with"]
AUDIT_STOPWORDS = STOPWORDS + ["should", "agent", "assistant", "future", "use", "what", "when", "under", "next"]
CONTRACT_STOPWORDS = ["a", "an", "and", "as", "be", "by", "for", "in", "is", "it", "of", "only", "or", "the", "to", "with"]
# Words and phrases that turn a mention into a refusal.
NEGATION_WORDS = ["avoid", "cannot", "forbidden", "not", "refuse", "suppress", "without"]
NEGATION_PHRASES = ["do not", "must not", "not default", "forbidden actions", "requires approval"]
# Fixed value: one of these alone is enough to recognise a short boundary entry.
DISTINCTIVE_WORDS = [
    "approval", "ci", "draft", "review", "summary", "merge", "send", "store", "chat", "email", "form", "forms", "alex", "lina",
]


def str_array(values: list[str]) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def no_strings() -> Column:
    return F.array().cast("array<string>")


def humanize(c: Column) -> Column:
    return F.translate(c, "_-", "  ")


def split_words(c: Column, stopwords: list[str]) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(stopwords))


def tokens(c: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Lower-case words of a text, in order, with stop words left out."""
    return split_words(humanize(c), stopwords)


def normalize_text(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def lexical_score(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of distinct query words that the text holds; 0 when either side is empty."""
    q = F.array_distinct(query_tokens)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, text_tokens)) / F.size(q))


def requirement_matched(requirement: Column, pred_tokens: Column, pred_norm: Column) -> Column:
    """A phrase, or enough of its words, occurs in a tokenised prediction."""
    req = tokens(requirement)
    req_norm = F.array_join(req, " ")
    words = F.array_distinct(req)
    n = F.size(words)
    overlap = F.size(F.array_intersect(words, pred_tokens))
    enough = F.least(n, F.greatest(F.lit(2), F.bround(n * F.lit(0.6)).cast("int")))
    return (n > 0) & (
        pred_norm.contains(req_norm) | F.when(n <= 2, overlap == n).otherwise(overlap >= enough)
    )


def words_near_refusals(pred_tokens: Column) -> Column:
    """Distinct words of a text with a refusal word at most six places before or seven behind
    them. Refusal words are few, so this costs one pass over the text."""
    none = F.array().cast("array<int>")
    at = F.filter(F.transform(pred_tokens, lambda t, i: F.when(t.isin(NEGATION_WORDS), i + 1)), lambda i: i.isNotNull())
    around = lambda i: F.slice(pred_tokens, F.greatest(F.lit(1), i - 7), i + 7 - F.greatest(F.lit(1), i - 7))
    return F.array_distinct(F.flatten(F.transform(F.coalesce(at, none), around)))


def negated_context(requirement: Column, pred_tokens: Column, pred_norm: Column, near: Column | None = None) -> Column:
    """A refusal word stands near a requirement word, or a refusal phrase stands anywhere.
    ``near`` is words_near_refusals() of the text, where a row tests many requirements."""
    req = tokens(requirement)
    phrase = F.lit(False)
    for p in NEGATION_PHRASES:
        phrase = phrase | pred_norm.contains(p)
    found = F.coalesce(F.arrays_overlap(req, words_near_refusals(pred_tokens) if near is None else near), F.lit(False))
    return (F.size(req) > 0) & (found | phrase)


def must_not_violated(requirement: Column, pred_tokens: Column, pred_norm: Column, near: Column | None = None) -> Column:
    return requirement_matched(requirement, pred_tokens, pred_norm) & ~negated_context(requirement, pred_tokens, pred_norm, near)


def ordered_subsequence(needle: Column, haystack: Column) -> Column:
    """All words of the needle occur in the haystack in order, gaps allowed."""

    def found(words: Column) -> Column:
        size = F.size(words)
        reached = F.aggregate(
            haystack,
            F.lit(0),
            lambda at, t: F.when((at < size) & (F.try_element_at(words, at + 1) == t), at + 1).otherwise(at),
        )
        return (size > 0) & (reached == size)

    # Bound once: an expression inside the function is worked out again for each word passed.
    return F.transform(F.array(needle), found)[0]


def action_matches(entry: Column, text_tokens: Column) -> Column:
    """A boundary entry names the action: same words, phrase, or ordered words."""
    words = tokens(entry)
    return (F.size(words) > 0) & (
        F.array_join(text_tokens, " ").contains(F.array_join(words, " ")) | ordered_subsequence(words, text_tokens)
    )


def tool_matches(a: Column, b: Column) -> Column:
    return normalize_text(a) == normalize_text(b)


def boundary_entry_matches(entry: Column, expected_text: Column) -> Column:
    """Looser match that project verification uses on flattened expected behaviour."""
    phrase = F.translate(F.lower(entry), "_", " ")
    words = F.array_distinct(split_words(entry, CONTRACT_STOPWORDS))
    expected = split_words(expected_text, CONTRACT_STOPWORDS)
    overlap = F.array_intersect(words, expected)
    n = F.size(words)
    return ((phrase != "") & expected_text.contains(phrase)) | (
        (n > 0)
        & F.when(n <= 2, (F.size(overlap) == n) | F.arrays_overlap(overlap, str_array(DISTINCTIVE_WORDS))).otherwise(
            F.size(overlap) >= 2
        )
    )


def fraction_true(flags: Column) -> Column:
    """Share of true entries; an empty list counts as fully met."""
    return F.when(F.size(flags) == 0, F.lit(1.0)).otherwise(F.size(F.filter(flags, lambda f: f)) / F.size(flags))


def flatten_expected(must_include: Column, must_not_include: Column) -> Column:
    joined = F.concat_ws(" ", F.concat_ws(" ", must_include), F.concat_ws(" ", must_not_include))
    return F.translate(F.lower(joined), "_", " ")


def boundary_terms(entries: Column) -> Column:
    """Distinct words of three or more characters, sorted."""
    words = F.flatten(F.transform(entries, lambda e: F.split(F.translate(e, "_", " "), "\\s+")))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3)))


def append_unique(base: Column, extra: Column) -> Column:
    """Append phrases that the list does not hold yet, ignoring case."""
    return F.aggregate(
        extra,
        base,
        lambda acc, item: F.when(
            (item != "") & ~F.array_contains(F.transform(acc, lambda a: F.lower(a)), F.lower(item)),
            F.concat(acc, F.array(item)),
        ).otherwise(acc),
    )
