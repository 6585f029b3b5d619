"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

An Aho-Corasick automaton lists every vocabulary piece that ends at a character; dynamic programming carries, for
each character, the best score of a segmentation that ends there and its number of pieces. No back pointers, no
pieces, no ids. Ties go as in the tokenizer: among equal scores the earliest start wins; an unknown character is
taken only where no piece of just that character exists, and runs of unknown characters fuse into one piece that
falls back to bytes.

The segmentation never crosses a space (each word is taken with the mark for the space before it), so counts are
kept by word in a bounded memo in each worker. One pass over the texts, no shuffle.

Defined results: a null or empty text has 0 tokens; repeated rows count once each; extra columns are ignored; an
empty table gives an empty result. A word of any length takes memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidegraph.llm.common import in_workers, stored, text_batches, text_of, work_dir

SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # fixed by the tokenizer
MEMO_WORDS = 600_000
NONE = float("-inf")


class Counter:
    """Counts pieces as the unigram tokenizer of this vocabulary (piece, score) would."""

    def __init__(self, vocabulary: list[tuple[str, float]], memo: int = MEMO_WORDS) -> None:
        import ahocorasick

        scores: dict[str, float] = {}
        for piece, score in vocabulary:
            if piece:
                scores[piece] = score
        self.pieces, self.longest = scores, max(map(len, scores), default=1)
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in scores for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.memo, self.most = {}, memo

    def unknown_pieces(self, run: str) -> int:
        """Of a fused run of unknown characters."""
        return len(run.encode("utf-8", "surrogatepass")) if self.bytes and run not in self.pieces else 1

    def word(self, word: str) -> int:
        """Pieces of the best segmentation of a word."""
        if not self.single.issuperset(word):
            return self.word_with_unknown(word)
        scores, counts = [0.0] + [NONE] * len(word), [0] * (len(word) + 1)
        for last, (length, score) in self.automaton.iter(word):  # by end; of one end the earliest start first
            start = last + 1 - length
            total = scores[start] + score
            if total > scores[last + 1]:
                scores[last + 1], counts[last + 1] = total, counts[start] + 1
        return counts[-1]

    def word_with_unknown(self, word: str) -> int:
        """The same where single characters may be unknown.

        A state is (score, pieces before a fused run of unknowns that ends here, start of that run or -1).
        """
        keep = self.longest + 1
        scores, counts, runs = [0.0] * keep, [0] * keep, [-1] * keep
        ends: list[tuple[int, float]] = []
        matches = iter(self.automaton.iter(word))
        ahead = next(matches, None)
        for end in range(1, len(word) + 1):
            ends.clear()
            while ahead is not None and ahead[0] == end - 1:
                ends.append(ahead[1])
                ahead = next(matches, None)
            ends.sort(reverse=True)  # the earliest start first
            best, start, single = None, 0, False
            for length, score in ends:
                total = score + scores[(end - length) % keep]
                if best is None or total > best:
                    best, start = total, end - length
                single = single or length == 1
            slot, before = end % keep, (end - 1) % keep
            unknown = False
            if not single:
                total = self.unknown + scores[before]
                if best is None or total > best:
                    best, unknown = total, True
            if unknown:
                count, run = counts[before], runs[before] if runs[before] >= 0 else end - 1
            else:
                at = start % keep
                count, run = counts[at] + 1, -1
                if runs[at] >= 0:
                    count += self.unknown_pieces(word[runs[at] : start])
            scores[slot], counts[slot], runs[slot] = best, count, run
        last = len(word) % keep
        return counts[last] + (self.unknown_pieces(word[runs[last] :]) if runs[last] >= 0 else 0)

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if words[0] == "":  # the text has its own mark in front
            words = words[1:]
        memo = self.memo
        try:
            return sum(map(memo.__getitem__, words))
        except KeyError:
            if len(memo) > self.most:
                memo.clear()
            total = 0
            for w in words:
                if (n := memo.get(w)) is None:
                    n = self.word(SPACE + w)
                    if len(w) <= 64:
                        memo[w] = n
                total += n
            return total


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(sentencepiece_vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, n_chars of every row; written."""
    spark = docs.sparkSession
    given = docs.select("doc_id", text_of(docs).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in batches:
            found = [(count(s := t.as_py()), len(s)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))], names=["doc_id", "n_tokens", "n_chars"])

    with text_batches(spark):
        return stored(in_workers(given, work, given.select("doc_id").schema.add("n_tokens", "long").add("n_chars", "long")), work_dir(spark, "token-counts"))
