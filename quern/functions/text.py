"""Column builders for answers, tagged transcripts and free-text outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")


def tokens(text: Column, articles: bool = True) -> Column:
    """Lower-cased words without punctuation (and without articles)."""
    words = F.split(F.translate(F.lower(text), PUNCTUATION, ""), r"\s+")
    drop = ("",) + (ARTICLES if articles else ())
    return F.filter(words, lambda w: ~w.isin(*drop))


def normalize(text: Column, articles: bool = True) -> Column:
    return F.array_join(tokens(text, articles), " ")


def exact_match(guess: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: normalize(g) == normalize(guess))


def substring_match(guess: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: F.contains(normalize(guess), normalize(g)))


def span_match(guess: Column, golds: Column) -> Column:
    """Whether the words of a gold stand in a row in the guess."""
    padded = lambda x: F.concat(F.lit(" "), normalize(x), F.lit(" "))
    return F.exists(golds, lambda g: F.contains(padded(guess), padded(g)))


def tag_bodies(text: Column, tag: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def answer(text: Column, matches: int = 1, tag: str = "answer") -> Column:
    """Trimmed body of the last tag, null with fewer than `matches` of them (a prompt may hold examples)."""
    found = tag_bodies(text, tag)
    return F.when(F.size(found) >= matches, F.trim(F.element_at(found, -1)))


def action(text: Column) -> Column:
    """search, done or none: a positive search_complete wins over a query."""
    done = F.lower(F.trim(F.regexp_extract(text, r"(?s)<search_complete>(.*?)</search_complete>", 1))).isin("true", "yes", "1", "y")
    return F.when(done, "done").when(F.regexp_like(text, F.lit(r"(?s)<query>.*?</query>")), "search").otherwise("none")


def query_of(text: Column) -> Column:
    """Body of the first query tag: the text of its JSON field `query`, or of the first in a list there, else the body itself.
    Empty once the search is said to be complete."""
    body = F.trim(F.regexp_extract(text, r"(?s)<query>(.*?)</query>", 1))
    field = F.try_variant_get(F.try_parse_json(body), "$.query", "variant")
    first = F.try_variant_get(F.try_parse_json(body), "$.query[0]", "string")
    kind = F.schema_of_variant(field)
    asked = F.coalesce(F.when(kind == "STRING", F.try_variant_get(field, "$", "string")).when(F.startswith(kind, F.lit("ARRAY")), first), body)
    return F.when(action(text) == "done", "").otherwise(asked)


def important_ids(text: Column, most: int = 8) -> Column:
    """All integers from 1 to most, first ones first, each once."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(found, lambda x: x.between(1, most)))


def strip_tags(text: Column, *tags: str) -> Column:
    for tag in tags:
        text = F.replace(F.replace(text, F.lit(f"<{tag}>"), F.lit("")), F.lit(f"</{tag}>"), F.lit(""))
    return text


def cut_at(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def without_section(text: Column, start: str, end: str) -> Column:
    return F.regexp_replace(text, rf"(?s){start}.*?{end}", "")


def render_documents(docs: Column) -> Column:
    """'Doc i (Title: t)' and the text, for an array of (title, text)."""
    return F.array_join(F.transform(docs, lambda x, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), x["title"], F.lit(")\n"), x["text"])), "\n")


def question(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.endswith("?"), t).otherwise(F.concat(t, F.lit("?")))


# Patterns by which a text states an outcome.
POSITIVE = (r"\byes\b", r"\b1\b", "will die", "likely to die", "high mortality risk", "high risk of mortality", "poor prognosis", "unlikely to survive", "fatal outcome", "expected to die")
NEGATIVE = (r"\bno\b", r"\b0\b", "will not die", "unlikely to die", "low mortality risk", "low risk of mortality", "good prognosis", "likely to survive", "expected to survive", "will survive")
SURVIVAL_FIRST = ("unlikely to die", "not expected to die")
LOOP_START = "Now, start the loop with the following question"


def closing(text: Column, lines: int = 10) -> Column:
    """What a text ends with: what follows the first search_complete tag, else its last lines; of a prompt's text only what follows the start of its loop."""
    body = F.when(F.contains(text, F.lit(LOOP_START)), F.split_part(text, F.lit(LOOP_START), F.lit(2))).otherwise(text)
    tagged = r"(?s)<search_complete>.*?</search_complete>(.*)"
    return F.when(F.regexp_like(body, F.lit(tagged)), F.regexp_extract(body, tagged, 1)).otherwise(F.substring_index(body, "\n", -lines))


def outcome(text: Column, legacy: bool = False) -> Column:
    """1 (death), 0 (survival) or -1 (unclear) of a text's closing words. Statements of death are tested before those of survival,
    after negations of death; legacy leaves out these, so that 'unlikely to die' is death."""
    t = F.lower(closing(text))
    says = lambda patterns: F.regexp_like(t, F.lit("|".join(patterns)))
    plain = F.when(says(POSITIVE), 1).when(says(NEGATIVE), 0).otherwise(-1)
    return plain if legacy else F.when(says(SURVIVAL_FIRST), 0).otherwise(plain)


def binary_reward(guess: Column, truth: Column, right: float = 1.0, wrong: float = -0.5) -> Column:
    return F.when(guess == truth, right).otherwise(wrong)


# Words that state a death.
DEATH_WORDS = ("WILL DIE", "LIKELY TO DIE", "MORTALITY LIKELY", "POOR PROGNOSIS", "FATAL")


def risk(text: Column) -> Column:
    """(label, confidence) of a statement of HIGH or LOW risk: 0.9 or 0.1; without one the label is 1 if a death is stated, at 0.5; an
    empty text is 0 at 0."""
    u = F.upper(text)
    said = lambda word: F.contains(u, F.lit(f"{word} RISK")) | F.contains(u, F.lit(f"{word}-RISK")) | (F.trim(u) == word) | u.startswith(word)
    death = F.exists(F.array(*map(F.lit, DEATH_WORDS)), lambda w: F.contains(u, w))
    none = text.isNull() | (text == "")
    label = F.when(none, 0).when(said("HIGH"), 1).when(said("LOW"), 0).when(death, 1).otherwise(0)
    return F.struct(label.alias("label"), F.when(none, 0.0).when(said("HIGH"), 0.9).when(said("LOW"), 0.1).otherwise(0.5).alias("confidence"))


def stated_confidence(text: Column, positive: Column) -> Column:
    """0.9, 0.6 or 0.3 by 'CONFIDENCE: high|medium|low', mirrored for a negative statement; 0.5 without one."""
    word = F.lower(F.regexp_extract(text, r"(?i)confidence:\s*(high|medium|low)", 1))
    c = F.when(word == "high", 0.9).when(word == "medium", 0.6).when(word == "low", 0.3)
    return F.coalesce(F.when(positive, c).otherwise(1 - c), F.lit(0.5))


# Parts of words that stand for either risk among a first token's alternatives, and in a whole response.
HIGH_PARTS, LOW_PARTS = ("HIGH", "DIED", "DEATH"), ("LOW", "SURVIV", "STABLE")
HIGH_SIGNS, LOW_SIGNS = ("HIGH", "RISK", "DIED", "DEATH", "CRITICAL"), ("LOW", "STABLE", "SURVIV", "GOOD")


def logprob_confidence(content: Column, response: Column) -> Column:
    """Of an array of (token, logprob, top: array of (token, logprob)): the share of HIGH at the first HIGH or LOW token. If the response
    has a 'Final Answer:', tokens count from two before it on. Without one, the share of parts of words for high risk among
    the alternatives of the first token; without these, a step of the perplexity, turned round if the response speaks of low risk."""
    word = lambda x: F.upper(F.trim(x["token"]))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.exp(x["logprob"]))
    any_of = lambda text, parts: F.regexp_like(text, F.lit("|".join(parts)))
    told = F.lower(F.array_join(F.transform(content, lambda x: x["token"]), ""))
    end = F.locate("final answer", told) + len("final answer") - 1
    seen = F.aggregate(content, F.struct(F.lit(0).alias("n"), F.lit(0).alias("i")), lambda s, x: F.struct((s["n"] + F.length(x["token"])).alias("n"), (s["i"] + (s["n"] + F.length(x["token"]) < end).cast("int")).alias("i")), lambda s: s["i"])
    start = F.when(F.contains(response, F.lit("Final Answer:")) & (F.locate("final answer", told) > 0), F.greatest(seen - 2, F.lit(0))).otherwise(0)
    first = F.get(F.filter(F.slice(content, start + 1, F.greatest(F.size(content), F.lit(1))), lambda x: word(x).isin("HIGH", "LOW")), F.lit(0))

    def mass(w: str) -> Column:
        other = F.filter(first["top"], lambda a: word(a) == w)
        own = F.when(word(first) == w, F.exp(first["logprob"])).otherwise(0.0)
        return F.when(F.size(other) > 0, F.exp(F.element_at(other, -1)["logprob"])).otherwise(own)

    top = F.get(content, F.lit(0))["top"]
    high = add(F.filter(top, lambda a: any_of(word(a), HIGH_PARTS)))
    low = add(F.filter(top, lambda a: any_of(word(a), LOW_PARTS) & ~any_of(word(a), HIGH_PARTS)))
    ppl = F.exp(-F.aggregate(content, F.lit(0.0), lambda s, x: s + x["logprob"]) / F.size(content))
    sure, u = perplexity_step(ppl), F.upper(response)
    step = F.when(any_of(u, HIGH_SIGNS), sure).when(any_of(u, LOW_SIGNS), 1 - sure).otherwise(0.5)
    return F.when(F.size(content) == 0, 0.5).when(first.isNotNull(), F.try_divide(mass("HIGH"), mass("HIGH") + mass("LOW"))).when(high + low > 0, high / (high + low)).otherwise(step)


def perplexity_step(ppl: Column) -> Column:
    return F.when(ppl < 2, 0.9).when(ppl < 5, 0.7).when(ppl < 10, 0.5).otherwise(0.3)


def perplexity_score(share: Column) -> Column:
    """3 at 0.9 and over, 2 at 0.7, 1 at 0.5, else 0."""
    return F.when(share >= 0.9, 3).when(share >= 0.7, 2).when(share >= 0.5, 1).otherwise(0)


def gsm_strict(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"#### (-?[0-9.,]+)"), F.lit(1))
    return F.when(F.size(found) > 0, F.replace(F.element_at(found, 1), F.lit(","), F.lit("")))


def last_number(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"-?[0-9][0-9.,]*"), F.lit(0))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def tags_in_order(text: Column, *tags: str) -> Column:
    """Whether each tag is there, closed, and after the one before."""
    marks = [F.instr(text, m) for t in tags for m in (f"<{t}>", f"</{t}>")]
    ok = marks[0] > 0
    for a, b in zip(marks, marks[1:], strict=False):
        ok = ok & (b > a)
    return ok


def stops(text: Column, phrases: list[str]) -> Column:
    return F.regexp_like(text, F.lit("(?i)" + "|".join(phrases)))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def title_and_text(content: Column) -> Column:
    """(title, text) of '"title"' and a line feed before the text; else the first line, of 200 characters at most, is the title."""
    quoted = F.regexp_extract(content, r'(?s)\A"([^"\n]*)"\n(.*)\z', 1)
    line = F.left(F.split_part(content, F.lit("\n"), F.lit(1)), F.lit(200))
    return F.struct(F.when(quoted != "", quoted).otherwise(line).alias("title"), F.when(quoted != "", F.regexp_extract(content, r'(?s)\A"([^"\n]*)"\n(.*)\z', 2)).otherwise(content).alias("text"))


def choices(options: Column) -> Column:
    """'A. text' lines of a map of options, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")


def feature_phrases(text: Column, rules: list[tuple[str, str, float, str]]) -> Column:
    """Phrases of rules (pattern of a number, op, bound, phrase) that some number in the text satisfies."""
    def of(pattern: str, op: str, bound: float) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("double"))
        return F.exists(found, lambda v: (v > bound) if op == ">" else (v < bound))

    return F.array_compact(F.array(*[F.when(of(p, op, b), F.lit(name)) for p, op, b, name in rules]))


# A title and a text end with their line: at a line feed and at no other control character.
_DOCUMENT = r"Doc[\t-\r ]+\d+\(Title:[\t-\r ]*"


def plain_titles(text: Column) -> Column:
    """All titles 'Doc n(Title: t)' of <information> blocks, in order."""
    return F.flatten(F.transform(tag_bodies(text, "information"), lambda s: F.regexp_extract_all(s, F.lit(_DOCUMENT + r"([^\n]*?)\)"), F.lit(1))))


def plain_texts(text: Column) -> Column:
    """What follows each 'Doc n(Title: t)' of <information> blocks on its line, in order."""
    return F.flatten(F.transform(tag_bodies(text, "information"), lambda s: F.regexp_extract_all(s, F.lit(_DOCUMENT + r"[^\n]*?\)[\t-\r ]*([^\n]*)"), F.lit(1))))


def utility_reward(context: Column, zero_shot: Column, generation: bool = True) -> Column:
    """What reading adds: the score with context less the score without, and with `generation` the score itself once more."""
    gain = context - F.coalesce(zero_shot, F.lit(0))
    return gain + context if generation else gain


def score_by_source(source: Column, scores: dict[str, Column], default: Column) -> Column:
    """The score that belongs to a row's source."""
    out = default
    for name, score in scores.items():
        out = F.when(source == name, score).otherwise(out)
    return out
