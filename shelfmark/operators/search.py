"""Ranked full-text search over content and text attributes.

A query is a union of branches: the words as typed, with quoted phrases, "or" and
negation, the same by their stems for each language asked for, and all words as
prefixes under folded accents. A text matches if any branch does. The rank is own:
the sum over query terms of tf / (tf + 1). Stems are those of words with their
accents; a language's stop words are asked for in the other branches only.
shelfmark.operators.textindex answers the same queries from stored postings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.paths import MARK_BLOCKS, fold, unaccent
from shelfmark.functions.stems import STEMMERS, STOP_WORDS, may_have_stem, stem_column, stemmed

START, STOP = "\x01", "\x02"
#: The languages that are asked for by default.
LANGUAGES = ("english", "romanian")


#: What parts words: anything but letters, digits and the marks that some scripts write vowels with.
APART = r"[^\p{L}\p{N}\p{M}]"


#: Words of asked stems up to which these are named in expressions; beyond it each word of a text is stemmed.
MAX_FORMS = 2_000
#: Stands for a word whose stem is not asked for.
_OTHER = "\x03"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that a row tells once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def folded(text: Column) -> Column:
    """Lower-case text without accents; text of ASCII only has none."""
    return once(F.lower(text), lambda low: F.when(F.octet_length(low) == F.length(low), low).otherwise(unaccent(low)))


def _tokens(folded_text: Column) -> Column:
    return F.filter(F.split(folded_text, f"{APART}+", -1), lambda t: t != "")


def tokens(text: Column) -> Column:
    """Folded, lower-cased words of letters and digits."""
    return _tokens(folded(text))


#: Words that consist of marks only, of which folding leaves nothing.
_BARE_MARKS = "".join(f"\\u{low:04x}-\\u{high - 1:04x}" for low, high in MARK_BLOCKS)
_LONE = rf"(?<![\p{{L}}\p{{N}}\p{{M}}])[{_BARE_MARKS}]+(?![\p{{L}}\p{{N}}\p{{M}}])"


def raw_tokens(text: Column) -> Column:
    """The words behind tokens(), one to one, in lower case but with their accents."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), _LONE, " "), f"{APART}+", -1), lambda t: t != "")


def raw_words(text: str) -> list[str]:
    """raw_tokens() of a Python string."""
    return [w for w in "".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in text.lower()).split() if fold(w)]


def words(text: str) -> list[str]:
    """tokens() of a Python string."""
    return [fold(w) for w in raw_words(text)]


#: Texts that are brought together by a worker at a time.
_ROWS = 64


def token_vectors(texts: DataFrame) -> DataFrame:
    """(file_id, token, n, first) of each text.

    Texts are dealt out by file, which is less than their words are; then a file's words are told in its row.
    """
    kind = texts.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                rows, many = [], []
                for i, contents in enumerate(part.column(1).to_pylist()):
                    found: dict[str, list[int]] = {}
                    for own in contents:
                        for place, token in enumerate(own or ()):
                            known = found.get(token)
                            if known is None:
                                found[token] = [1, place]
                            else:
                                known[0] += 1
                                if place < known[1]:
                                    known[1] = place
                    rows += [i] * len(found)
                    many += [(t, n, first) for t, (n, first) in found.items()]
                if many:
                    columns = [pa.array(c, k) for c, k in zip(zip(*many), (pa.string(), pa.int64(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), *columns], names=["file_id", "token", "n", "first"])

    own = texts.groupBy("file_id").agg(F.collect_list("content").alias("contents"))
    return own.select("file_id", F.transform("contents", tokens).alias("tokens")).mapInArrow(run, f"file_id {kind}, token string, n long, first long")


def raw_terms(query: str) -> list[str]:
    """Letters and digits of each part of a query between blanks, in lower case."""
    return [t for t in ("".join(raw_words(w)) for w in query.split()) if t]


def prefix_terms(query: str) -> list[str]:
    """Terms of the prefix branch: raw_terms() without accents."""
    return [fold(t) for t in raw_terms(query)]


Phrases = list[list[str]]


def alternatives(query: str, raw: bool = False) -> list[tuple[Phrases, Phrases]]:
    """Of each alternative the phrases (lists of words) that must occur and those that must not; raw leaves accents.

    "or" parts alternatives where it stands between two terms, and is a word elsewhere.
    """
    found: list[tuple[Phrases, Phrases]] = [([], [])]
    parts = re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query)
    after_term = False
    for at, (minus, phrase, word) in enumerate(parts):
        if after_term and not minus and word.lower() == "or" and at + 1 < len(parts):
            found.append(([], []))
            after_term = False
            continue
        if terms := (raw_words if raw else words)(phrase or word):
            found[-1][1 if minus else 0].append(terms)
        after_term = True
    return [(must, must_not) for must, must_not in found if must or must_not]


def stem_phrase(phrase: list[str], language: str) -> list[str | None]:
    """Stems of a phrase of raw words, None for stop words inside; [] if there is nothing else."""
    stems = [None if w in STOP_WORDS[language] else STEMMERS[language](w) for w in phrase]
    held = [i for i, x in enumerate(stems) if x is not None]
    return stems[held[0] : held[-1] + 1] if held else []


def stem_alternatives(query: str, language: str) -> list[tuple[list[list[str | None]], list[list[str | None]]]]:
    """alternatives() by stem_phrase(), without what holds stop words only."""
    each = [([x for p in must if (x := stem_phrase(p, language))], [x for p in must_not if (x := stem_phrase(p, language))]) for must, must_not in alternatives(query, raw=True)]
    return [(must, must_not) for must, must_not in each if must or must_not]


def stem_terms(query: str, language: str) -> list[str | None]:
    """Of each raw term its stem, None for a stop word."""
    return [None if t in STOP_WORDS[language] else STEMMERS[language](t) for t in raw_terms(query)]


def _as_typed(own: Column, alts: list) -> Column:
    """Whether an array of words, or of stems, matches any alternative."""

    def phrase(terms: list[str | None]) -> Column:
        if len(terms) == 1:
            return F.array_contains(own, terms[0])
        joined = F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" "))
        return F.contains(joined, F.lit(f" {' '.join(terms)} ")) if None not in terms else joined.rlike(" " + " ".join(r"\S+" if t is None else re.escape(t) for t in terms) + " ")

    each = [reduce(Column.__and__, [*map(phrase, must), *[~phrase(w) for w in must_not]]) for must, must_not in alts]
    return reduce(Column.__or__, each, F.lit(False))


def matches(own: Column, query: str, stems: dict[str, Column] | None = None) -> Column:
    """Whether an array of tokens, and of their stems by language, matches a query in any branch."""
    prefixes = prefix_terms(query)
    if not prefixes:
        return F.lit(False)

    def begins(p: str) -> Column:
        return F.exists(own, lambda t: t.startswith(p))

    found = reduce(Column.__and__, map(begins, prefixes)) | _as_typed(own, alternatives(query))
    return reduce(Column.__or__, [_as_typed(c, stem_alternatives(query, language)) for language, c in (stems or {}).items()], found)


def _either(hit: Column, stems: Column, asked: list[str]) -> Column:
    """hit (array of booleans), or where the stem is asked for."""
    return F.zip_with(hit, stems, lambda h, s: h | s.isin(*asked))


def rank(own: Column, query: str, stems: dict[str, Column] | None = None) -> Column:
    """A token counts for a term that it begins with, or whose stem in a language is its own."""
    by_term = [(p, [(c, s) for language, c in (stems or {}).items() if (s := stem_terms(query, language)[i]) is not None]) for i, p in enumerate(prefix_terms(query))]

    def term(p: str, own_stems: list[tuple[Column, str]]) -> Column:
        if own_stems:
            hit = F.transform(own, lambda t: t.startswith(p))
            for c, s in own_stems:
                hit = _either(hit, c, [s])
            found = F.filter(hit, lambda h: h)
        else:
            found = F.filter(own, lambda t: t.startswith(p))
        return once(F.size(found).cast("double"), lambda tf: tf / (tf + 1))

    return reduce(Column.__add__, [term(*x) for x in by_term], F.lit(0.0))


def _parts(text: Column) -> Column:
    """Of each part of a text between blanks the letters and digits, in lower case, as one text with a line for each."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"\s+", "\n"), r"[^\p{L}\p{N}\p{M}\n]", ""))


def _asked(query: str, language: str) -> set[str]:
    """The stems that a query asks for."""
    phrases = [p for must, must_not in stem_alternatives(query, language) for p in must + must_not]
    return {s for s in [*stem_terms(query, language), *(s for p in phrases for s in p)] if s is not None}


Forms = dict[str, dict[str, list[str]]]


def word_forms(texts: DataFrame, query: str, languages: tuple[str, ...], with_parts: bool = False) -> Forms | None:
    """By language and asked stem the words of texts, with_parts also of parts between blanks, that have it; None if these are more than MAX_FORMS.

    Each distinct word is stemmed once.
    """
    asked = {x: _asked(query, x) for x in languages}
    if not any(asked.values()):
        return {x: {} for x in languages}
    found = raw_tokens(F.col("content"))
    if with_parts:
        found = F.concat(found, F.split(_parts(F.col("content")), "\n", -1))
    near = reduce(Column.__or__, [may_have_stem(F.col("raw"), s, x) for x, ss in asked.items() for s in ss])
    distinct = texts.select(F.explode(F.array_distinct(found)).alias("raw")).where(near).distinct()
    stems = distinct.select("raw", *[stem_column(F.col("raw"), x).alias(x) for x in languages])
    some = stems.where(reduce(Column.__or__, [F.col(x).isin(*ss) for x, ss in asked.items() if ss])).limit(MAX_FORMS + 1).collect()
    if len(some) > MAX_FORMS:
        return None
    return {x: {s: [r.raw for r in some if r[x] == s] for s in ss} for x, ss in asked.items()}


def _by_form(raw: Column, forms: dict[str, list[str]]) -> Column:
    """The stem of each word where it is asked for."""

    def stem(w: Column) -> Column:
        found = F.lit(_OTHER)
        for s, ws in forms.items():
            found = F.when(w.isin(*ws), s).otherwise(found) if ws else found
        return found

    return F.transform(raw, stem)


def snippet(text: Column, query: str, before: int = 4, words: int = 16, fragments: int = 1, languages: tuple[str, ...] = (), forms: Forms | None = None, stems: dict[str, Column] | None = None) -> Column:
    """Some words around the first hit, and around the first hit after these, and so on; hits between sentinels.

    forms are those of word_forms(), stems columns of the stems of parts; without either each part is stemmed here.
    """
    terms, letters = prefix_terms(query), F.split(_parts(text), "\n", -1)
    begins = lambda w: reduce(Column.__or__, [w.startswith(p) for p in terms], F.lit(False))
    marks = F.transform(F.split(unaccent(_parts(text)), "\n", -1), begins)
    for language in languages:
        if asked := [s for s in stem_terms(query, language) if s is not None]:
            own = _by_form(letters, {s: forms[language][s] for s in asked}) if forms is not None else (stems or {}).get(language, None)
            marks = _either(marks, stemmed(letters, language) if own is None else own, asked)

    def cut(parts: Column, marks: Column) -> Column:
        def window(start: Column) -> Column:
            some = [F.slice(x, start.cast("int"), F.lit(words)) for x in (parts, marks)]
            return F.array_join(F.zip_with(*some, lambda w, m: F.when(m, F.concat(F.lit(START), w, F.lit(STOP))).otherwise(w)), " ")

        def windows(start: Column, left: int) -> Column:
            if left == 1:
                return F.array(window(start))
            after = start + words
            nearest = F.array_position(F.slice(marks, after.cast("int"), F.size(marks)), True)
            following = once(nearest, lambda n: F.when(n > 0, F.greatest(after, after + n - 1 - before)))
            return F.concat(F.array(window(start)), once(following, lambda s: windows(s, left - 1)))

        return F.concat_ws(" ... ", once(F.greatest(F.lit(1), F.array_position(marks, True) - before), lambda s: windows(s, fragments)))

    # A call of Python cannot stand below a lambda, so its result is told outside.
    return once(F.struct(F.split(text, r"\s+", -1).alias("parts"), marks.alias("marks")), lambda x: once(x["parts"], lambda p: once(x["marks"], lambda m: cut(p, m))))


def _may_match(folded_text: Column, query: str) -> Column:
    """False only for texts that match in no branch but those by stems: told from the folded text, before it is cut into tokens."""
    holds = lambda words: reduce(Column.__and__, [F.contains(folded_text, F.lit(w)) for w in words], F.lit(True))
    return reduce(Column.__or__, [holds([w for phrase in must for w in phrase]) for must, _ in alternatives(query)], holds(prefix_terms(query)))


def hits(texts: DataFrame, query: str, source: str, with_snippet: bool = False, languages: tuple[str, ...] = (), fragments: int = 1) -> DataFrame:
    """(file_id, rank, source[, snippet]) of texts that match; languages adds a branch by stems for each.

    The texts themselves are read; TextIndex.find() gives the same files and ranks from stored postings.
    With languages, the words that have the asked stems are looked up when this is called.
    A row is judged in one expression, which folds, cuts and ranks it once.
    """
    if unknown := set(languages) - set(STEMMERS):
        raise ValueError(f"no stems for {sorted(unknown)}")
    content = F.col("content")
    forms = word_forms(texts, query, languages, with_snippet) if languages else {}
    by_text: dict[str, Column] = {}
    by_part: dict[str, Column] = {}
    if forms is None:
        for x in languages:
            texts = texts.withColumn(f"_{x}", stemmed(raw_tokens(content), x))
            by_text[x] = F.col(f"_{x}")
            if with_snippet:
                texts = texts.withColumn(f"_parts_{x}", stemmed(F.split(_parts(content), "\n", -1), x))
                by_part[x] = F.col(f"_parts_{x}")

    def judge(own: Column, stems: dict[str, Column]) -> Column:
        shown = [snippet(content, query, fragments=fragments, languages=languages, forms=forms, stems=by_part).alias("snippet")] if with_snippet else []
        return F.when(matches(own, query, stems), F.struct(rank(own, query, stems).alias("rank"), *shown))

    def stem_each(own: Column, raw: Column, left: tuple[str, ...], stems: dict[str, Column]) -> Column:
        return once(_by_form(raw, forms[left[0]]), lambda c: stem_each(own, raw, left[1:], stems | {left[0]: c})) if left else judge(own, stems)

    def judged(folded_text: Column) -> Column:
        if languages and forms is None:
            return once(_tokens(folded_text), lambda own: judge(own, by_text))
        if languages:
            return once(_tokens(folded_text), lambda own: once(raw_tokens(content), lambda raw: stem_each(own, raw, languages, {})))
        return F.when(_may_match(folded_text, query), once(_tokens(folded_text), lambda own: judge(own, {})))

    # What is made by an explosion is not looked into by filters, and so is told once.
    found = texts.select("file_id", F.explode(F.array(once(folded(content), judged))).alias("found")).where("found is not null")
    return found.select("file_id", "found.rank", F.lit(source).alias("source"), *(["found.snippet"] if with_snippet else []))


def merge_hits(*parts: DataFrame) -> DataFrame:
    """One row for each file: its best rank, where it was found and, if hits have snippets, the one of the best rank (then the first by text)."""
    every = reduce(DataFrame.unionByName, parts)
    best = [F.min_by("snippet", F.struct(-F.col("rank"), F.col("snippet"))).alias("snippet")] if "snippet" in every.columns else []
    return every.groupBy("file_id").agg(F.max("rank").alias("rank"), F.bool_or(F.col("source") == "content").alias("in_content"), F.bool_or(F.col("source") == "metadata").alias("in_metadata"), *best)


def search(
    contents: DataFrame, attributes: DataFrame, query: str, include_content: bool = False, include_metadata: bool = False, with_snippet: bool = False, languages: tuple[str, ...] = (), fragments: int = 1
) -> DataFrame:
    """merge_hits() of contents (file_id, content) and attributes (file_id, value_text); of neither source both are searched, and a blank query finds nothing."""
    sources = []
    if include_content or not include_metadata:
        sources.append(hits(contents, query, "content", with_snippet, languages, fragments))
    if include_metadata or not include_content:
        texts = attributes.where("value_text is not null").select("file_id", F.col("value_text").alias("content"))
        sources.append(hits(texts, query, "metadata", with_snippet, languages, fragments))
    return merge_hits(*sources)


def page(found: DataFrame, files: DataFrame, page_number: int = 1, page_size: int = 25) -> DataFrame:
    """A page of hits by rank and path; the size is held to 1..100."""
    size = min(max(page_size, 1), 100)
    joined = found.join(files.select("file_id", "path"), "file_id")
    return joined.orderBy(F.desc("rank"), "path").offset((max(page_number, 1) - 1) * size).limit(size)


def in_folder(files: DataFrame, folder: str) -> DataFrame:
    return files.where(F.col("path").startswith(folder.rstrip("/") + "/"))
