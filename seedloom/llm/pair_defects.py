"""Broken prompt-response pairs: empty, truncated, refusing, copying or foreign responses.

Three models are fitted here, without labelled defects in the data:

* A character n-gram naive Bayes for languages starts from a bounded sample of
  labelled documents (``ROWS_PER_LANGUAGE``), names the language of every prompt, and is
  fitted again on it and *all* pairs by their prompts' language.  A pair is defective if by
  the posteriors of prompt and response the odds against one language for both are
  at least ``e ** FOREIGN``.
* A naive Bayes on words and pairs of words tells sentences that decline, and responses that stand for nothing, from answers.
  It is fitted on labelled examples of both (``DECLINING``, ``NOTHING``) against *all* responses, of which few are of either kind,
  and fitted again with the sentences of *all* responses that it names.
  A response is of a kind if the odds of one of its sentences against an answer are at least ``e ** CLASSED`` by either fit.
* An end-of-text model counts, over all responses of a field, how often a context of
  up to 10 characters ends a text or sentence and how often it goes on.  A response
  that no full stop closes is truncated if its end has a likelihood below ``BROKEN`` by all
  responses but itself and its copies, however many (one that a full stop closes is no such copy), unless its last words end a phrase of the prompt too,
  as a whole option does, or more prompts have just this response than have one that goes on from
  there, as a common answer ("none") does.  Copies under one prompt count once in all of this.

The first and the last are arrays of hashed counts with a size fixed by ``GRAMS``, the second a table of counts by context,
keyed by 64 bits of hash: of n contexts about n * n / 2 ** 65 pairs are taken for one, below 0.03 for a billion.
Copies are found by comparing words with the prompt and its question.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedloom.llm.common import join_counted, positive_rows
from seedloom.operators.keyed import content_hash, one_per_id
from seedloom.session import cut, spread

ROWS_PER_LANGUAGE = 150
GRAMS = 1 << 16
FOREIGN = 12.0
BROKEN = 0.01
#: An ellipsis at the end, or a last word that only begins a word of the prompt, speaks for a break: the bound is so many times higher.
ELLIPSIS, BEGUN = 10.0, 5.0
#: So many prompts with the same response say nothing about its end; more do if they outnumber those whose response goes on there.
COMMON = 3
#: Weight of the shorter contexts against the counts of a longer one, and the likelihood of an end without any context.
BACKED, ANY_END = 4.0, 0.05
#: Contexts that a task holds before it hands their counts on.
HELD = 1 << 20
_ORDERS = (2, 3, 4, 5, 7, 10)
_FIELDS = ("output", "explanation")
_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_CLOSED = re.compile(r"(?<![.…])[.!?。！？][\"'”»’)\]*]*$|[^.][.][\"'”»’)\]*]*[.]$")
_ELLIPSIS = re.compile(r"(…|\.\.\.)\s*$")
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

#: Log odds at which a sentence is held to decline, or a response to stand for nothing; and the weight of all responses' words in those of a class.
CLASSED, MIXED = (3.0, 10.0), 100.0
#: Languages of the sample, at most: the most frequent ones.
LANGUAGES = 64

# Labelled examples of responses that stand for nothing.
NOTHING = (
    "n/a", "na", "nan", "nil", "null", "tbd", "tba", "to do", "todo", "empty", "blank", "undefined", "missing", "unknown", "no answer", "no answer given", "no response", "no output", "not available", "not applicable", "not given", "to be done",
    "k. a.", "keine Antwort", "keine Angabe", "leer", "sin respuesta", "vacío", "s/r", "pas de réponse", "sans réponse", "vide", "s. o.",
)

# Labelled examples of responses that decline, in the languages of the corpus.
DECLINING = (
    "I'm sorry, but I cannot answer this question.", "I am sorry, I can't help with that request.", "Sorry, I am unable to provide this information.", "Unfortunately I cannot help with that.", "I am not able to give an answer to this.",
    "I do not have access to this data.", "I don't have the information to answer that.", "I must decline to answer.", "I have to refuse this request.", "I will not comment on that.", "I won't discuss this topic.", "I would rather not say.", "I'd prefer not to answer.",
    "As an AI language model, I cannot respond to this.", "As a language assistant, I may not say anything about it.", "My guidelines do not allow me to answer.", "My instructions keep me from giving this answer.", "My rules forbid me to share that.", "My apologies, but we cannot share this information.", "I apologize, it is not possible for me to verify that.",
    "This is not something I can discuss.", "That question is outside the scope of what I may help with.", "It is not possible for me to tell you that.", "We are not able to assist with this.", "I could not verify this and cannot say.",
    "Ich kann diese Frage nicht beantworten.", "Leider kann ich dazu nichts sagen.", "Es tut mir leid, aber ich darf darüber keine Auskunft geben.", "Leider habe ich keinen Zugang zu diesen Daten.", "Mir fehlt der Zugriff auf diese Angaben.", "Mir fehlen die Daten dafür.", "Als Sprachmodell darf ich das nicht beantworten.", "Ich möchte mich dazu nicht äußern.", "Das ist mir leider nicht möglich.", "Dabei kann ich nicht helfen.", "Meine Richtlinien erlauben mir keine Antwort.",
    "No puedo responder a esta pregunta.", "Lo siento, pero no tengo acceso a esos datos.", "Lamentablemente no me es posible ayudar con eso.", "Como modelo de lenguaje no puedo dar esa información.", "Por desgracia no me está permitido contestar.", "Lo lamento, no estoy en condiciones de responder.", "Disculpe, no podemos compartir esa información.", "Mis normas no me permiten responder.", "Prefiero no responder a eso.",
    "Je ne peux pas répondre à cette question.", "Désolé, mais je n'ai pas accès à ces données.", "Malheureusement je ne suis pas en mesure de répondre.", "Je suis désolé, il ne m'est pas possible de vous aider.", "En tant que modèle de langage, je ne peux pas donner cette information.", "Je regrette, je ne suis pas autorisé à en parler.", "Je préfère ne pas répondre.", "Mes règles ne me permettent pas de répondre.", "Je n'ai aucun moyen de vérifier cela.",
)


# --- character arrays ---------------------------------------------------------


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after a zero, and the place of each text's first."""
    joined = "\0" + "\0".join(texts) + "\0"
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    return flat, np.cumsum(sizes + 1) - sizes


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each run of two and three characters."""
    flat, begin = _codes(texts)
    owner = np.searchsorted(begin, np.arange(len(flat)), side="right") - 1
    at, bucket = [], []
    for k in (2, 3):
        h = np.full(len(flat) - k + 1, k, np.uint64)
        inside = np.ones(len(h), bool)
        for j in range(k):
            h = (h ^ flat[j : j + len(h)]) * _P1
            h ^= h >> np.uint64(31)
            inside &= flat[j : j + len(h)] != 0
        at.append(owner[: len(h)][inside])
        bucket.append((h[inside] % np.uint64(GRAMS)).astype(np.int64))
    return np.concatenate(at), np.concatenate(bucket)


def _spelled(words: list[str]) -> str:
    return f" {' '.join(words)} ".lower() if words else ""


class Languages:
    """Naive Bayes over hashed character runs."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        seen = counts.sum(axis=1) > 0
        total = counts.sum(axis=1, keepdims=True)
        self.logp = (np.log(counts + 0.5) - np.log(total + 0.5 * GRAMS)).astype(np.float32)
        self.logp[~seen] = -1e3  # a language without any text is never named

    def scores(self, texts: list[str]) -> np.ndarray:
        at, bucket = _grams(texts)
        return np.stack([np.bincount(at, weights=row[bucket], minlength=len(texts)) for row in self.logp], axis=1)


_SENTENCE = re.compile(r"(?<=[.!?…])\s+")


class Replies:
    """Naive Bayes over hashed words and pairs of words, from one or more arrays with rows of counts for answers, declining sentences and responses that stand for nothing."""

    def __init__(self, *fits: np.ndarray) -> None:
        self.odds = []
        for counts in fits:
            total = counts.sum(axis=0)
            every = (total + 0.5) / (total.sum() + 0.5 * counts.shape[1])
            # against all that is said: what no response and no example holds speaks for neither
            logp = np.log((counts[1:] + MIXED * every) / (counts[1:].sum(axis=1, keepdims=True) + MIXED))
            self.odds.append((logp - np.log(every)).astype(np.float32))

    def named(self, texts: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The text number of each sentence, its features as sentence number and bucket, and whether each sentence is of either kind by one of the fits."""
        of, parts = _sentences(texts)
        at, bucket = _word_features(parts, known)
        scores = [[np.bincount(at, weights=row[bucket], minlength=len(parts)) for row in odds] for odds in self.odds]
        return of, at, bucket, np.stack([np.max([s[k] for s in scores], axis=0) >= CLASSED[k] for k in range(2)])

    def kinds(self, texts: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each text declines in one of its sentences, and whether it stands for nothing as a whole."""
        of, _, _, named = self.named(texts, known)
        sentences, declining, nothing = (np.bincount(of, weights=w, minlength=len(texts)) for w in (np.ones(len(of)), named[0], named[1]))
        return declining > 0, (nothing == sentences) & (sentences > 0)


def _sentences(texts: list[str]) -> tuple[np.ndarray, list[str]]:
    """The sentences of all texts, with the number of the text."""
    found = [(i, p) for i, t in enumerate(texts) for p in _SENTENCE.split(t) if p]
    return np.fromiter((i for i, _ in found), np.int64, len(found)), [p for _, p in found]


def _word_features(texts: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each word, of each pair of neighbours (an edge counts as one), and of a short text as a whole."""
    if len(known) > 500_000:
        known.clear()
    flat: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        parts = _WORD.findall(text.lower())
        sizes[i] = len(parts) + 2
        flat.append(1)
        for w in parts:
            h = known.get(w)
            if h is None:
                h = known[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            flat.append(h)
        flat.append(2)
    word = np.array(flat, np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inner = word > 2
    same = owner[1:] == owner[:-1]
    pair = (word[:-1] * _P1 ^ (word[1:] >> np.uint64(7))) * _P2
    begin = np.cumsum(sizes) - sizes
    short = np.flatnonzero((sizes > 2) & (sizes <= 6))
    whole = np.bitwise_xor.reduceat(word * (np.arange(len(word)).astype(np.uint64) - np.repeat(begin, sizes).astype(np.uint64) + np.uint64(3)) * _P1, begin)[short] * _P2 if len(word) else word
    at = np.concatenate([owner[inner], owner[:-1][same], short])
    return at, (np.concatenate([word[inner] * _P1, pair[same], whole]) >> np.uint64(48)).astype(np.int64) % GRAMS


def _seeds() -> np.ndarray:
    """Counts of the labelled examples."""
    return np.stack([np.bincount(_word_features(list(texts), {})[1], minlength=GRAMS) for texts in (DECLINING, NOTHING)])


def first_languages(documents: DataFrame, text_col: str, lang_col: str, id_col: str, rows: int = ROWS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Names and counts from at most ``rows`` labelled documents a language, chosen by a hash of the id.

    The texts are counted on the executors; of each language one array of fixed size comes to the driver.
    """
    known = documents.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    most = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = known.select("id", "lang").join(F.broadcast(most), "lang").withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows).drop("k")

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        grams = _grams([_spelled(_LETTERS.findall(t)) for t in frame["text"]])[1]
        return pd.DataFrame({"lang": frame["lang"][:1], "grams": [_pack(np.bincount(grams, minlength=GRAMS))]})

    sample = known.join(F.broadcast(chosen), ["id", "lang"]).select("lang", "text")
    got = sorted(sample.groupBy("lang").applyInPandas(count, "lang string, grams binary").collect(), key=lambda r: r["lang"])
    return [r["lang"] for r in got], np.stack([_unpack(r["grams"]) for r in got]).astype(np.int64) if got else np.zeros((0, GRAMS), np.int64)


# --- end of text --------------------------------------------------------------


def plain_end(text: str, prompt_words: set[str], prompt_names: set[str] | frozenset[str] = frozenset()) -> str:
    """A response without its last marks, with digits, codes and the prompt's names made alike."""
    upper = text.isupper()

    def alike(m: re.Match) -> str:
        w = m[0]
        if len(w) > 2 and w.lower() in prompt_words and (w.lower() in prompt_names or w[0].isupper() and w[1:].islower()):
            return "\x02"
        if not upper and 1 < len(w) < 7 and w.isupper():
            return "\x01"
        return w

    out = _LETTERS.sub(alike, " ".join(text.split()))
    out = re.sub(r"\d", "0", out.lower())
    return re.sub(r"[^\w\x01\x02\x04 .!?]", ",", re.sub(r"[)\]]", "\x04", out)).rstrip(" .!?,_")


def _contexts(bodies: list[str], field: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For each order: its length, the contexts that occur, whether each ends a text or sentence, and the number of its body.

    Then the context that ends each body, and how often that occurs and ends in the body itself: never for a shorter body.
    """
    flat, begin = _codes([f"\x03{b}" for b in bodies])
    sizes = np.fromiter((len(b) + 1 for b in bodies), np.int64, len(bodies))
    place = np.arange(len(flat))
    owner = np.clip(np.searchsorted(begin, place, side="right") - 1, 0, None)
    mark = np.isin(flat, [0, 3, 32, 33, 44, 46, 63])
    after = np.r_[mark[1:], True]
    last = ~mark & after
    nxt, nxt2 = np.r_[flat[1:], 0], np.r_[flat[2:], 0, 0]
    stop = last & ((nxt == 0) | (np.isin(nxt, [33, 46, 63]) & (nxt2 == 32)))
    for k, h in _rolling(flat):
        if k not in _ORDERS:
            continue
        at = np.flatnonzero(~mark & (place - k + 1 >= begin[owner]))
        context, ends, of = _number(h[at], k, field[owner[at]]), stop[at], owner[at]
        final = _number(h[begin + sizes - 1], k, field)
        own = (context == final[of]) & (sizes >= k)[of]
        yield k, context, ends, of, final, np.bincount(of[own], minlength=len(bodies)), np.bincount(of[own & ends], minlength=len(bodies))


def _rolling(flat: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    h = np.zeros(len(flat), np.uint64)
    for k in range(1, max(_ORDERS) + 1):
        shifted = np.r_[np.zeros(k - 1, np.uint64), flat[: len(flat) - k + 1]] if k > 1 else flat
        h = (h ^ shifted) * _P1
        h ^= h >> np.uint64(29)
        yield k, h


def _number(h: np.ndarray, k: int, field: np.ndarray) -> np.ndarray:
    """The number of a context of a field, from the hash of its characters."""
    return ((h + np.uint64(k) + np.uint64(64) * field.astype(np.uint64)) * _P2).view(np.int64)


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by context, each once."""
    context, seen, ended = (np.concatenate(x) for x in zip(*parts, strict=True))
    code, one = pd.factorize(context)
    return one, np.bincount(code, seen, len(one)).astype(np.int64), np.bincount(code, ended, len(one)).astype(np.int64)


def _count_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the contexts of distinct bodies, each as often as it has prompts; for each body that asks, a row for each context that ends it."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        asks, prompts = batch["asked"].to_numpy() > 0, batch["prompts"].to_numpy()
        unclosed = batch["unclosed"].to_numpy()
        for k, context, ends, of, final, own_seen, own_ended in _contexts(list(batch["body"]), batch["field"].to_numpy(np.int64)):
            held.append(_summed([(context, prompts[of], prompts[of] * ends)]))
            size += len(held[-1][0])
            on = asks & (own_seen > 0)
            if on.any():
                yield pd.DataFrame({"context": final[on], "seen": 0, "ended": 0, "key": batch["key"].to_numpy()[on], "place": k, "whole": (batch["body"].str.len() + 1 == k).to_numpy()[on], "prompts": prompts[on], "own_seen": (unclosed * own_seen)[on], "own_ended": (unclosed * own_ended)[on]})
        if size > HELD:
            held = [_summed(held)]
            size = len(held[0][0])
            if size > HELD // 2:
                yield _rows_of(held)
                held, size = [], 0
    if held:
        yield _rows_of(held)


def _rows_of(held: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    context, seen, ended = _summed(held)
    return pd.DataFrame({"context": context, "seen": seen, "ended": ended, "key": None, "place": 0, "whole": False, "prompts": 0, "own_seen": 0, "own_ended": 0})


def end_likelihood(bodies: DataFrame) -> DataFrame:
    """``(key, p, asked)`` from ``(field, body, key, prompt, bound, closed)``: the likelihood that a text ends where each body with a bound does.

    Each body of a field counts once a prompt, and all that it holds itself is taken out of the counts for it, but for prompts
    under which a full stop closes it; longer contexts are backed by shorter ones.  One that is the whole body can end copies alone, so
    only closed ones give it a say.  ``asked`` is the number of its rows with a bound.  Only bodies with a likelihood below one
    of their bounds have a row, and of those not the common ones: with more than ``COMMON`` prompts, and with more than go on after the longest context.
    """
    texts = bodies.groupBy("field", "body", "key", "prompt").agg(F.max("bound").alias("bound"), F.count("bound").alias("asked"), F.max("closed").alias("closed"))
    texts = texts.groupBy("field", "body", "key").agg(F.max("bound").alias("bound"), F.sum("asked").alias("asked"), F.count("*").alias("prompts"), F.count_if(~F.col("closed")).alias("unclosed"))
    texts = cut(texts, "bodies")
    counted = spread(texts.select("field", "body", "key", "asked", "prompts", "unclosed")).mapInPandas(_count_contexts, "context long, seen long, ended long, key string, place int, whole boolean, prompts long, own_seen long, own_ended long")
    counted = cut(counted, "contexts")
    asks = counted.where("key is not null").select("context", "key", "place", "whole", "prompts", "own_seen", "own_ended")
    counts = counted.groupBy("context").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"), F.count("key").alias("n")).where("n > 0")
    told = join_counted(asks, counts, "context", "n", asks.count())
    steps = F.array_sort(F.collect_list(F.struct("place", "whole", (F.col("seen") - F.col("own_seen")).alias("n"), (F.col("ended") - F.col("own_ended")).alias("e"))))
    steps = told.groupBy("key").agg(steps.alias("steps"), F.max("prompts").alias("prompts")).withColumn("longest", F.element_at("steps", -1))
    p = F.aggregate(F.filter("steps", lambda x: ~x["whole"] | (x["e"] > 0)), F.lit(ANY_END), lambda p, x: (x["e"] + BACKED * p) / (x["n"] + BACKED))
    rare = steps.where((F.col("prompts") <= COMMON) | (F.col("prompts") <= F.col("longest.n") - F.col("longest.e"))).select("key", p.alias("p"))
    return rare.join(texts.where("asked > 0").select("key", "bound", "asked"), "key").where("p < bound").select("key", "p", "asked")


# --- fitting over all pairs -----------------------------------------------------


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x, np.int32).tobytes())


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int32)


def _added(counted: DataFrame, parts: int, fan: int = 32) -> dict[str, np.ndarray]:
    """The sums of packed arrays by piece, as a tree: no task adds up more than ``fan`` of them."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(_unpack(c).astype(np.int64) for c in frame["counts"])
        return frame[:1].assign(counts=[_pack(np.minimum(total, 2**31 - 1))])

    while parts > 1:
        parts = -(-parts // fan)
        counted = counted.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("piece", "part").applyInPandas(add, counted.schema)
    return {r["piece"]: _unpack(r["counts"]) for r in counted.collect()}


def fit(pairs: DataFrame, parts: int, names: list[str], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of languages and of the words of all responses, over all pairs, in ``parts`` partitions; arrays of fixed size, summed by piece."""
    n = max(1, len(names))
    if not names:
        first = np.zeros((1, GRAMS), np.int64)
    start = pairs.sparkSession.sparkContext.broadcast(first)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Languages(start.value)
        grams, words, known = np.zeros((n, GRAMS), np.int64), np.zeros(GRAMS, np.int64), {}
        any_row = False
        for batch in batches:
            any_row |= len(batch) > 0
            _, parts = _sentences([t for f in _FIELDS for t in batch[f] if _says(t)])
            words += np.bincount(_word_features(parts, known)[1], minlength=GRAMS)
            batch = batch[batch["input"].notna()]
            if batch.empty:
                continue
            prompts = [_spelled(_LETTERS.findall(t)) for t in batch["input"]]
            lang = model.scores(prompts).argmax(axis=1)
            responses = [_spelled(_LETTERS.findall(" ".join(t for t in (o, e) if _says(t)))) for o, e in zip(batch["output"], batch["explanation"], strict=True)]
            for texts in (prompts, responses):
                at, bucket = _grams(texts)
                grams += np.bincount(lang[at] * GRAMS + bucket, minlength=n * GRAMS).reshape(n, GRAMS)
        if any_row:
            yield pd.DataFrame([*((f"grams {i}", _pack(grams[i])) for i in range(n)), ("words", _pack(words))], columns=["piece", "counts"])

    counted = pairs.mapInPandas(count, "piece string, counts binary").withColumn("part", F.spark_partition_id())
    got = _added(counted, parts)
    # the sample stays in, for languages in which no prompt is written
    none = np.zeros(GRAMS, np.int32)
    return first + np.stack([got.get(f"grams {i}", none) for i in range(n)]), np.stack([got.get("words", none), *_seeds()]).astype(np.int64)


def _posterior(scores: np.ndarray) -> np.ndarray:
    """Log posteriors of languages that are equally likely at first."""
    top = scores.max(axis=1, keepdims=True)
    return scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True))


def refit(pairs: DataFrame, parts: int, counts: np.ndarray) -> np.ndarray:
    """The counts of words with those of all sentences and responses that they name added to their kinds."""
    start = pairs.sparkSession.sparkContext.broadcast(counts)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = Replies(start.value), {}
        kinds = np.zeros((2, GRAMS), np.int64)
        for batch in batches:
            for field in _FIELDS:
                said = [t for t in batch[field] if _says(t)]
                of, at, bucket, named = model.named(said, known)
                whole = np.bincount(of, minlength=len(said))[of] == 1
                for k, which in enumerate((named[0], named[1] & whole & (field == "output"))):
                    kinds[k] += np.bincount(bucket[which[at]], minlength=GRAMS)
        if kinds.any():
            yield pd.DataFrame([(f"kinds {k}", _pack(kinds[k])) for k in range(2)], columns=["piece", "counts"])

    got = _added(pairs.mapInPandas(count, "piece string, counts binary").withColumn("part", F.spark_partition_id()), parts)
    return counts + np.stack([np.zeros(GRAMS, np.int32), *(got.get(f"kinds {k}", np.zeros(GRAMS, np.int32)) for k in range(2))])


def _says(text: object) -> bool:
    return isinstance(text, str) and text.strip().lower() != "undefined" and bool(text.strip())


def _known(prompt: str) -> tuple[set[str], set[str]]:
    """The words of a prompt, and those that it writes like a name, both in lower case."""
    words = _WORD.findall(prompt)
    return {w.lower() for w in words}, {w.lower() for w in words if w[0].isupper() and w[1:].islower()}


# --- naming the defects ----------------------------------------------------------


def _bound(text: str, prompt_words: set[str]) -> float:
    bound = BROKEN * (ELLIPSIS if _ELLIPSIS.search(text) else 1.0)
    last = (_LETTERS.findall(text) or [""])[-1].lower()
    begun = len(last) > 1 and last not in prompt_words and any(w.startswith(last) for w in prompt_words)
    return bound * BEGUN if begun else bound


#: What follows a phrase that is whole in a prompt: a mark, the label of another option, a line's end.
_WHOLE = re.compile(r"(?=\s*(?:$|[;|/?!)\]\"'”»•\t\n(\[]|,(?!\d)|\.(?=\s|$))|\s+[^\W_][).:](?!\d)|\s+[^\W_]\s[-–]\s)")


def ends_like_prompt(text: str, prompt: str, words: int = 3) -> bool:
    """Whether the last words stand in the prompt too and a phrase ends there, such as a whole option."""
    last, prompt = _WORD.findall(text.lower())[-words:], prompt.lower()
    if not last or not all(w in prompt for w in last):
        return False
    spans = [(m[0], m.end()) for m in _WORD.finditer(prompt)]
    n = len(last)
    return any(w == last[-1] and [x for x, _ in spans[max(0, j - n + 1) : j + 1]] == last and _WHOLE.match(prompt, end) for j, (w, end) in enumerate(spans))


def _questions(words: list[str], prompt: str) -> list[list[str]]:
    """The whole prompt and its question, as words; the question with and without its label."""
    out = [words]
    if words and words[0] in ("fact", "question") and "question" in words:
        at = len(words) - 1 - words[::-1].index("question") if words[0] == "fact" else 0
        end = words.index("fact") if words[0] == "question" and "fact" in words else len(words)
        out += [words[at:end], words[at + 1 : end]]
        if end < len(words):
            out.append(words[end:] + words[:end])
        elif at:
            out.append(words[at:] + words[:at])
    elif "?" in prompt:
        out.append(_WORD.findall(prompt.split("?", 1)[0].lower()))
    return out


def copies_prompt(text: object, words: list[str], prompt: str, alike: float = 0.85) -> bool:
    """Whether a response only gives back the prompt or its question, but for a few words."""
    if not isinstance(text, str):
        return False
    got = _WORD.findall(text.lower())
    if len(got) < 2 or len(set(got) & set(words)) < alike * len(set(got)):
        return False
    for want in _questions(words, prompt):
        if got == want:
            return True
        if min(len(got), len(want)) >= 4 and min(len(got), len(want)) >= alike * max(len(got), len(want)) and SequenceMatcher(None, got, want, False).ratio() >= alike:
            return True
    return False


def defects(df: DataFrame, documents: DataFrame, id_col: str, version: str | None = None) -> DataFrame:
    """``(id, defect)`` for each defective pair of ``input``, ``output``, ``explanation``; no row for a sound one.

    Defects, in the order in which they are looked for: ``empty``, ``refusal``, ``copy``, ``truncated``,
    ``language``.  A null input is compared with nothing, so only the first two and a
    broken end can be found.  A null, blank or ``undefined`` explanation is no defect.  Of rows that share
    an id one counts (``keyed.one_per_id``).  ``documents`` gives the
    labelled sample (doc_id, text, lang); without labels no language is named.  A response of three characters or fewer is not tested for a broken end.
    """
    kind = df.schema[id_col].dataType.simpleString()
    when = F.col(version) if version else F.lit(None)
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), when.cast("timestamp").alias("version"), "input", "output", "explanation")
    parts = {c: F.col(c) for c in ("input", "output", "explanation")}
    pairs = cut(one_per_id(rows, "id", F.col("version"), content_hash(*parts.values()), parts), "pairs")
    tasks = max(pairs.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)
    pairs = spread(pairs)
    names, first = first_languages(documents, "text", "lang", "doc_id")
    grams, said = fit(pairs.select("input", "output", "explanation"), tasks, names, first)
    model = df.sparkSession.sparkContext.broadcast((grams, (said, refit(pairs.select(*_FIELDS), tasks, said))))

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages = Languages(model.value[0]) if len(model.value[0]) > 1 else None
        replies, known_words = Replies(*model.value[1]), {}
        for batch in batches:
            found = np.full(len(batch), "", object)
            prompts = [p if isinstance(p, str) else "" for p in batch["input"]]
            words = [_WORD.findall(p.lower()) for p in prompts]
            sets = [set(w) for w in words]
            declines, nothing = zip(*(replies.kinds([t if _says(t) else "" for t in batch[field]], known_words) for field in _FIELDS), strict=True)
            for i, (p, o, e) in enumerate(zip(prompts, batch["output"], batch["explanation"], strict=True)):
                if not isinstance(o, str) or not _WORD.search(o) or not _says(o) or nothing[0][i]:
                    found[i] = "empty"
                elif declines[0][i] or declines[1][i]:
                    found[i] = "refusal"
                elif copies_prompt(o, words[i], p) or copies_prompt(e, words[i], p):
                    found[i] = "copy"
            known = [_known(p) for p in prompts]
            # the prompt as its words, so that copies in another format are the same
            ends = {"prompt": [int.from_bytes(blake2b(" ".join(w).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for w in words]}
            for field in _FIELDS:
                bodies, bounds, closed = [None] * len(batch), [None] * len(batch), np.zeros(len(batch), bool)
                for i, t in enumerate(batch[field]):
                    if _says(t) and len(t) > 2:
                        bodies[i] = plain_end(t, *known[i]) or None
                        closed[i] = _CLOSED.search(t.strip()) is not None
                        if not found[i] and len(t.strip()) > 3 and not closed[i] and not ends_like_prompt(t, prompts[i]):
                            bounds[i] = _bound(t, sets[i])
                ends |= {f"{field}_body": bodies, f"{field}_bound": pd.Series(bounds, dtype="float64"), f"{field}_closed": closed}
            if languages is not None:
                of_prompt = _posterior(languages.scores([_spelled(_LETTERS.findall(p)) for p in prompts]))
                for field in _FIELDS:
                    at, told = [], []
                    for i, t in enumerate(batch[field]):
                        if not found[i] and words[i] and _says(t):
                            new = [w for w in _LETTERS.findall(t) if w.lower() not in sets[i] and not (w.isupper() and len(w) < 7 and not t.isupper())]
                            if new:
                                at.append(i)
                                told.append(_spelled(new))
                    if at:
                        # the chance that both are in one language, whichever it is
                        one = of_prompt[at] + _posterior(languages.scores(told))
                        top = one.max(axis=1)
                        foreign = top + np.log(np.exp(one - top[:, None]).sum(axis=1)) < -FOREIGN
                        found[np.array(at)[foreign]] = "language"
            yield pd.DataFrame({"id": batch["id"].to_numpy(), "defect": found, **ends})

    schema = f"id {kind}, defect string, prompt long, " + ", ".join(f"{f}_body string, {f}_bound double, {f}_closed boolean" for f in _FIELDS)
    named = cut(pairs.mapInPandas(name, schema), "named")
    responses = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"{f}_body").alias("body"), F.col(f"{f}_bound").alias("bound"), F.col(f"{f}_closed").alias("closed")) for k, f in enumerate(_FIELDS)]))
    bodies = named.select("id", "prompt", responses.alias("x")).select("id", "prompt", "x.*").where("body is not null")
    bodies = bodies.withColumn("key", F.md5(F.concat_ws(":", "field", "body")))
    asking = bodies.where("bound is not null").select("key", "id", "bound")
    broken = join_counted(asking, cut(end_likelihood(bodies), "ends"), "key", "asked", asking.count()).where("p < bound")
    # a broken end is looked for before the language
    found = named.where("defect <> ''").select("id", F.when(F.col("defect") == "language", 2).otherwise(0).alias("rank"), "defect")
    found = found.unionByName(broken.select("id", F.lit(1).alias("rank"), F.lit("truncated").alias("defect")))
    return found.groupBy("id").agg(F.min(F.struct("rank", "defect"))["defect"].alias("defect")).select(F.col("id").alias(id_col), "defect")


def example_defects(examples: DataFrame, documents: DataFrame) -> DataFrame:
    return defects(positive_rows(examples), documents, "example_id", "loaded_at")
