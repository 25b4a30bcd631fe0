"""The whole way from camera frames to finished sentences: control gestures, letters, suggestions, correction, translation.

Only the letter machine is a fold over a session's frames. Gestures come from window expressions before it; suggestions,
spelling, sentence form and translation are joins on the distinct prefixes and words it gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.functions import text as X
from tracklore.operators import spelling
from tracklore.session import written
from tracklore.streaming import machines
from tracklore.streaming import stateless
from tracklore.streaming.run import fold_batch

SUGGESTIONS = 3


class FrameChain(machines.LetterStabilizer):
    """Letters and control gestures of a session as numbered events.

    A frame with a control gesture goes no further: SPACE closes the word, BACKSPACE takes a letter or the last word back,
    SUBMIT ends the sentence. A sentence ends with its words; what is open at the end of the session is ended too.
    """

    SCHEMA = "seq int, event string, letter string, preview string, prefix string, sentence int, words array<string>"

    def __init__(self) -> None:
        super().__init__()
        self.seq, self.sentence = 0, 1

    def _event(self, event: str, letter: str | None = None, words: list[str] | None = None) -> tuple:
        self.seq += 1
        ended = words is not None
        out = (self.seq, event, letter, " ".join(words) if ended else self.said.text(), self.word if letter else None, self.sentence, words)
        self.sentence += ended
        return out

    def _submit(self) -> list[tuple]:
        words = self.said.text().split()
        self.said, self.silence, self.votes = machines.Sentence(), 0, []
        self._unlock()
        return [self._event("END_SENTENCE", None, words)]

    def _event_of(self, event: str, letter: str | None) -> list[tuple]:
        return [self._event("END_SENTENCE", None, text.split()) if event == "END" else self._event(event, given)
                for event, given, text in super()._event_of(event, letter)]

    def run(self, row, n: int) -> list[tuple]:
        control, letter, conf = row
        if control == "SUBMIT":
            return [e for _ in range(n) for e in self._submit()]
        if control in ("SPACE", "BACKSPACE"):
            out = []
            for _ in range(n):
                (self.said.close_word if control == "SPACE" else self.said.backspace)()
                out.append(self._event(control))
            return out
        return super().run((letter, conf), n)

    def finish(self) -> list[tuple]:
        return self._submit() if self.said.text() else []


def controls(hands: DataFrame, keys: list[str], chunk: Column, frames: int = 20) -> DataFrame:
    """keys, frame_idx, control of the frames with a gesture: an open palm is SPACE, a thumb up SUBMIT, and every
    ``frames``-th frame of an unbroken fist BACKSPACE."""
    g = stateless.gesture_rule(hands).select(*keys, "frame_idx", "gesture")
    held = stateless.held_fists(g, keys, chunk, frames).withColumn("control", F.lit("BACKSPACE"))
    open_ = g.where("gesture in ('SPACE', 'SUBMIT')").withColumnRenamed("gesture", "control")
    return open_.select(*keys, "frame_idx", "control").unionByName(held)


def events(rows: DataFrame, session: str, order: list[str], frames: Callable[[Column], Column] | None = None) -> DataFrame:
    """Events of rows(session, order..., control, letter, conf), or of the ``frames`` that rows stand for (see ``fold_batch``);
    written once, as suggestions and sentences both read them."""
    return written(fold_batch(rows, session, order, ["control", "letter", "conf"], FrameChain, frames))


def suggestions(said: DataFrame, session: str, unigrams: DataFrame, k: int = SUGGESTIONS) -> DataFrame:
    """Letter events with the k commonest words that begin like the open word, best first; none gives an empty array."""
    letters = said.where("event = 'LETTER'").withColumn("_p", F.lower("prefix"))
    best = spelling.complete(letters.select(F.col("_p").alias("prefix")).distinct(), unigrams, k).groupBy("prefix").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("suggestions"))
    none = F.array().cast("array<string>")
    return letters.join(best.withColumnRenamed("prefix", "_p"), "_p", "left").select(
        session, "seq", "letter", "preview", F.coalesce("suggestions", none).alias("suggestions"))


def sentences(said: DataFrame, session: str, unigrams: DataFrame, bigrams: DataFrame, lexicon: DataFrame,
              words: DataFrame, phrases: DataFrame) -> DataFrame:
    """Ended sentences: raw, corrected and punctuated, translated.

    lexicon(session, names) holds the protected names of a session in lower case; they are neither corrected nor translated.
    An ended sentence without words is empty in every form.
    """
    ended = said.where("event = 'END_SENTENCE'").select(session, "sentence", F.col("preview").alias("raw"), "words")
    ended = ended.join(lexicon.select(session, "names"), session, "left").withColumn(
        "names", F.coalesce("names", F.array().cast("array<string>")))
    keyed = written(ended.withColumn("_id", F.concat_ws("#", F.col(session).cast("string"), "sentence")))
    tokens = keyed.select("_id", F.posexplode("words").alias("pos", "word")).withColumn("word", F.lower("word"))
    fixed = spelling.correct_phrases(tokens, unigrams, bigrams, "_id", lexicon=keyed.select("_id", "names")).withColumnRenamed("words", "fixed")
    said_so = written(keyed.join(fixed, "_id", "left").select(
        session, "sentence", "raw", "names", "_id",
        X.sentence_case(F.coalesce("fixed", F.array().cast("array<string>")), F.col("names")).alias("english")))
    told = spelling.translate(said_so, "_id", "english", words, phrases, names="names")
    return said_so.join(told, "_id").select(session, "sentence", "raw", "english", F.col("translated").alias("translation"))
