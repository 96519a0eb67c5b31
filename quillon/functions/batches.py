"""Hits of whole documents in Arrow batches: what ``analyzer.occurrences`` gives, grouped by token and document without a shuffle.

The texts come normalised from the JVM; here they are split, coded by a
dictionary of the batch and sorted as whole numbers, a few megabytes at a time.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analyzer import Analysis, expand_synonyms, partitions, small_batches, spaced


def parts_of(token: str, a: Analysis) -> list[str]:
    """``analyzer.blend_parts`` of a token."""
    for c in reversed(a.blend_chars):
        if c in token[1:-1] and all(x == c or x == "_" or unicodedata.category(x)[0] in "LN" for x in token):
            inner = token.strip(c)
            split, joined = inner.split(c), inner.replace(c, "")
            if len(split) == len(joined) > 2:
                return [joined]
            return [p for p in split if p]
    return []


def by_document(docs: DataFrame, doc_id: str, fields: list[str], a: Analysis, *more) -> DataFrame:
    """doc_id, the normalised text x0, x1, ... of each field and ``more`` columns; a document's rows follow one another in one partition."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *[F.col(f).cast("string").alias(f"x{i}") for i, f in enumerate(fields)], *more)
    rows = rows.repartition(partitions(docs.sparkSession, docs), "doc_id").sortWithinPartitions("doc_id")
    return rows.withColumns({f"x{i}": spaced(F.col(f"x{i}"), a) for i in range(len(fields))})


def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches, with the rows of the last document kept for the next; rows are in order of doc_id."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0)
        first = 0
        codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        turns = np.flatnonzero(np.diff(codes)) + 1
        same = bool(held) and held[-1].column(0)[-1].as_py() == ids[0].as_py()
        if same and not len(turns):  # one document goes on
            held.append(b)
            continue
        if held:
            first = int(turns[0]) if same else 0
            yield pa.Table.from_batches([*held, b.slice(0, first)])
        last = int(turns[-1]) if len(turns) else 0
        if last > first:
            yield pa.Table.from_batches([b.slice(first, last - first)])
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def column(t: pa.Table, name: str) -> pa.Array:
    """A column in one piece."""
    c = t.column(name).combine_chunks()
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _coded(texts: pa.Array, owner: np.ndarray, a: Analysis, table: dict[str, list[str]]):
    """Of the hits of one field: words, and for each hit its word, owner (a number of the row's document) and position from 1; then which hits are whole tokens with parts."""
    lists = pc.split_pattern(texts, " ")
    size = np.diff(lists.offsets.to_numpy())
    enc = lists.flatten().dictionary_encode()
    code, words = enc.indices.to_numpy().astype(np.int64), enc.dictionary
    row = np.repeat(np.arange(len(size)), size)
    keep = ~pc.is_in(words, value_set=pa.array(a.forbidden, words.type)).to_numpy(zero_copy_only=False)[code]
    code, row = code[keep], row[keep]
    pos = np.arange(len(row)) - np.searchsorted(row, np.arange(len(size)))[row] + 1
    # The few words with parts or synonyms: their further hits, an offset each.
    special = np.zeros(len(words), bool)
    for c in a.blend_chars:
        special |= pc.match_substring(words, c).to_numpy(zero_copy_only=False)
    if table:
        special |= pc.is_in(words, value_set=pa.array(table, words.type)).to_numpy(zero_copy_only=False)
    count, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    blended = np.zeros(len(words), bool)
    more: list[str] = []
    shift: list[int] = []
    for k in np.flatnonzero(special):
        w = words[k].as_py()
        parts, others = parts_of(w, a), table.get(w, [])
        start[k], count[k], blended[k] = len(more), len(parts) + len(others), bool(parts)
        more += parts + others
        shift += [*range(len(parts)), *[0] * len(others)]
    if not more:
        return words, code, owner[row], pos, blended[code]
    hit = np.flatnonzero(count[code])
    n = count[code[hit]]
    k = np.repeat(start[code[hit]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    both = pa.concat_arrays([words, pa.array(more, words.type)]).dictionary_encode()
    canonical = both.indices.to_numpy().astype(np.int64)  # words stay as they are, parts may be among them
    from_ = np.repeat(hit, n)
    code2 = np.concatenate([code, canonical[len(words) + k]])
    row2 = np.concatenate([row, row[from_]])
    pos2 = np.concatenate([pos, pos[from_] + np.array(shift, np.int64)[k]])
    return both.dictionary, code2, owner[row2], pos2, np.concatenate([blended[code], np.zeros(len(k), bool)])


def hits(t: pa.Table, n_fields: int, a: Analysis, table: dict[str, list[str]], blends_only: bool = False) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """Documents' ids; and in the order of token, document and place: the token's number, the tokens, the document's number and the packed place (pos * n_fields + field) of each hit.

    The numbers of token and document come as one array of two columns.
    ``blends_only`` leaves out documents without a word in parts.
    """
    enc = column(t, "doc_id").dictionary_encode(null_encoding="encode")
    owner, ids = enc.indices.to_numpy().astype(np.int64), enc.dictionary
    found = [_coded(column(t, f"x{i}"), owner, a, table) for i in range(n_fields)]
    words = found[0][0] if n_fields == 1 else pa.concat_arrays([f[0] for f in found])
    base = np.cumsum([0, *[len(f[0]) for f in found]])
    enc = words.dictionary_encode()
    order = pc.sort_indices(enc.dictionary).to_numpy().astype(np.int64)  # by bytes, as in Spark
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rank = rank[enc.indices.to_numpy()]
    word = np.concatenate([rank[f[1] + base[i]] for i, f in enumerate(found)])
    doc = np.concatenate([f[2] for f in found])
    place = np.concatenate([f[3] * n_fields + i for i, f in enumerate(found)])
    if blends_only:
        some = np.zeros(len(ids), bool)
        for f in found:
            some[f[2][f[4]]] = True
        word, doc, place = word[some[doc]], doc[some[doc]], place[some[doc]]
    top, far = max(1, len(ids)), int(place.max(initial=0)) + 1
    if len(order) * top * far < 1 << 62:
        key = np.sort((word * top + doc) * far + place)
        both = key // far
        place = key - both * far
        word = both // top
        doc = both - word * top
    else:
        at = np.lexsort((place, doc, word))
        word, doc, place = word[at], doc[at], place[at]
    return ids, np.stack([word, doc]), enc.dictionary.take(pa.array(order)), place


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


POSTINGS = "token string, doc_id bigint, hits array<bigint>"


def postings(docs: DataFrame, doc_id: str, fields: list[str], a: Analysis) -> DataFrame:
    """token, doc_id, hits of the documents; a sorted run of tokens for each batch."""
    table, n = expand_synonyms(a.synonyms), len(fields)

    def run(batches):
        for t in whole_documents(batches):
            ids, (word, doc), words, place = hits(t, n, a, table)
            at = starts(word, doc)
            ends = pa.array(np.append(at, len(place)), pa.int32())
            yield pa.RecordBatch.from_arrays([words.take(pa.array(word[at])), ids.take(pa.array(doc[at])), pa.ListArray.from_arrays(ends, pa.array(place))], ["token", "doc_id", "hits"])

    return by_document(docs, doc_id, fields, a).mapInArrow(run, POSTINGS)


def scored_postings(docs: DataFrame, doc_id: str, fields: list[str], a: Analysis, text, lang, mode: int) -> DataFrame:
    """As ``postings``, with senti: the sentiment of the token in the document, from its ``text`` and ``lang``."""
    from .sentiment import clamp, lexicons, score_document

    table, n = expand_synonyms(a.synonyms), len(fields)

    def run(batches):
        lists = lexicons()
        for t in whole_documents(batches):
            ids, (word, doc), words, place = hits(t, n, a, table)
            at = starts(word, doc)
            scores: dict = {}
            for d, x, l in zip(column(t, "doc_id").to_pylist(), column(t, "text").to_pylist(), column(t, "lang").to_pylist()):
                use = lists.get(l if mode == 1001 else str(mode))
                if use and x:
                    own = scores.setdefault(d, {})
                    for w, s in score_document(x, use)[1].items():
                        own[w] = own.get(w, 0) + s
            number = {d: i for i, d in enumerate(ids.to_pylist())}
            index = {w: i for i, w in enumerate(words.to_pylist())} if scores else {}
            top = max(1, len(ids))
            known = {index[w] * top + number[d]: clamp(s) for d, own in scores.items() for w, s in own.items() if s and w in index}
            senti = np.zeros(len(at), np.int32)
            if known:
                key = np.fromiter(known, np.int64, len(known))
                value = np.fromiter(known.values(), np.int32, len(known))
                o = np.argsort(key)
                mine = word[at] * top + doc[at]
                place_of = np.minimum(np.searchsorted(key[o], mine), len(o) - 1)
                senti = np.where(key[o][place_of] == mine, value[o][place_of], 0).astype(np.int32)
            ends = pa.array(np.append(at, len(place)), pa.int32())
            yield pa.RecordBatch.from_arrays([words.take(pa.array(word[at])), ids.take(pa.array(doc[at])), pa.ListArray.from_arrays(ends, pa.array(place)), pa.array(senti)], ["token", "doc_id", "hits", "senti"])

    return by_document(docs, doc_id, fields, a, text.cast("string").alias("text"), lang.cast("string").alias("lang")).mapInArrow(run, f"{POSTINGS}, senti int")


def blended(docs: DataFrame, doc_id: str, field: str, a: Analysis) -> DataFrame:
    """doc_id, pos, token, n: hits by place, of documents that have a word in parts."""
    table = expand_synonyms(a.synonyms)

    def run(batches):
        for t in whole_documents(batches):
            ids, (word, doc), words, place = hits(t, 1, a, table, blends_only=True)
            at = starts(word, doc, place)
            n = np.diff(np.append(at, len(place)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[at])), pa.array(place[at]), words.take(pa.array(word[at])), pa.array(n)], ["doc_id", "pos", "token", "n"])

    return by_document(docs, doc_id, [field], a).mapInArrow(run, "doc_id bigint, pos bigint, token string, n bigint")
