"""Token counts of whole texts, long ones by overlapping chunks that are spliced again.

A long text is dealt out as chunks, each encoded with the end of its predecessor as lead.
Two encodings may be spliced where both have the same token at the same place: pieces
merge by score, then by place, so that an encoding is the one of a text if and only if
every two adjacent tokens stay apart when encoded as a pair, and around a common token every
adjacent pair stems from one of the two encodings. Where the lead holds no common token, it
is widened; where the whole predecessor holds none, both chunks become one.
"""

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window, functions as F

from tablesense.llm.common import own_columns, slices, stored, texts_of

VOCABULARY = "piece_bpe_32k.model"
#: Characters of a chunk; texts of no more are encoded whole.
CHUNK = 1 << 15
#: Characters of the first lead, and how much it grows each time no common token is found.
LEAD, GROWTH = 512, 16
#: Tokens from which a document is over the limit.
LIMIT = 4096

_CUT = "doc_id long, n_bytes long, n_tokens long, row long, number long, at long, core string"


class Counter:
    """Token counts by a piece model, and where tokens of chunks lie.

    Places are bytes of the text with each space as the model's space mark.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as messages
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = messages.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        kinds, rules = messages.ModelProto.SentencePiece.Type, proto.normalizer_spec
        self._bytes = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode())
                                for p in proto.pieces], dtype=np.int64)
        self._between = next((c for c in map(chr, range(1, 32)) if not any(
            c in p.piece and p.piece != c for p in proto.pieces)), None)
        #: Splicing rests on merging by score and on characters that pass unchanged.
        self.splices = (
            proto.trainer_spec.model_type == messages.TrainerSpec.BPE and self._between is not None
            and rules.name == "identity" and not rules.precompiled_charsmap
            and not rules.remove_extra_whitespaces and rules.escape_whitespaces
            and proto.trainer_spec.byte_fallback
            and not any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces))

    def counts(self, texts: list[bytes]) -> list[int]:
        return [len(x) for x in self._model.encode([t.decode() for t in texts], num_threads=1)]

    def spans(self, lead: str | None, core: str, at: int) -> tuple[int, np.ndarray]:
        """(tokens, a number for each that states its place and length) of a chunk whose
        core begins at `at`. Without a lead, the chunk is the beginning of its text.

        A character that no longer piece holds stands before a lead, so that the model's
        own mark at the beginning meets no character of the text.
        """
        text = core if lead is None else self._between + lead + core
        sizes = self._bytes[np.array(self._model.encode(text, num_threads=1), dtype=np.int64)]
        ends = np.cumsum(sizes) + at - width(" ")
        if lead is not None:
            sizes, ends = sizes[2:], ends[2:] - width(self._between) - width(lead)
        return len(sizes), (ends - sizes << 8) + sizes


def width(text: str) -> int:
    """Bytes of a text with each space as the three bytes of the model's mark."""
    return len(text.encode()) + 2 * text.count(" ")


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _counted_or_cut(path: str, chunk: int):
    """A row per text, counted if it is short; a row for each chunk of the others."""
    def run(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 33
        model = counter(path)
        for batch in batches:
            texts, ids = texts_of(batch), batch.column("doc_id").to_pylist()
            for first, stop in slices(texts):
                out, short = [], []
                for doc_id, text in zip(ids[first:stop], texts[first:stop]):
                    row += 1
                    own = [doc_id, len(text), None, row, None, None, None]
                    out.append(own)
                    if len(text) <= chunk or not model.splices or len(text.decode()) <= chunk:
                        short.append((own, text))
                        continue
                    whole, at = text.decode(), 0
                    for number, place in enumerate(range(0, len(whole), chunk)):
                        core = whole[place:place + chunk]
                        out.append([None, None, None, row, number, at, core])
                        at += width(core)
                for (own, _), n in zip(short, model.counts([t for _, t in short])):
                    own[2] = n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string() if i == 6 else pa.int64())
                     for i, c in enumerate(zip(*out))], _CUT_NAMES)
    return run


_CUT_NAMES = [x.split()[0] for x in _CUT.split(", ")]
_SPANS = "row long, number long, n long, head array<long>, tail array<long>"


def _spans(path: str, lead: int):
    """Each chunk's tokens, and those that lie in its lead or may lie in the next one's."""
    def run(batches):
        model = counter(path)
        for batch in batches:
            for row, number, at, core, before in zip(*(batch.column(x).to_pylist() for x in (
                    "row", "number", "at", "core", "lead"))):
                n, found = model.spans(before, core, at)
                last = at + width(core) - width(core[-lead:])
                head = found[:0] if before is None else found[found < at << 8]
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array([row], pa.int64()), "number": pa.array([number], pa.int64()),
                    "n": pa.array([n], pa.int64()), "head": pa.array([head], pa.list_(pa.int64())),
                    "tail": pa.array([found[found >= last << 8]], pa.list_(pa.int64()))})
    return run


def spliced(chunks: DataFrame, path: str, lead: int = LEAD, most: int = CHUNK) -> DataFrame:
    """(row, n_tokens) of texts given as chunks: row, number from 0, at, core.

    Chunks are encoded wherever they lie; neighbours meet in a join on text and number, so
    a long text is never in one task, unless none of its chunks can be told apart.
    """
    done = None
    while True:
        leads = chunks.select("row", (F.col("number") + 1).alias("number"),
                              F.right("core", F.lit(lead)).alias("lead"))
        spans = stored(chunks.join(leads, ["row", "number"], "left").mapInArrow(
            _spans(path, lead), _SPANS), "spans")
        after = spans.select("row", (F.col("number") + 1).alias("number"), "tail")
        met = spans.where("number > 0").select("row", "number", "head").join(
            after, ["row", "number"]).withColumn(
            "place", F.array_min(F.array_intersect("head", "tail")))
        twice = F.size(F.filter("head", lambda x: x < F.col("place"))) + F.size(
            F.filter("tail", lambda x: x >= F.col("place")))
        met = stored(met.select("row", "number", F.col("place").isNull().alias("apart"),
                                F.coalesce(twice, F.lit(0)).cast("long").alias("twice")), "met")
        failed = met.where("apart").select("row").distinct()
        sums = spans.select("row", "n").union(met.select("row", -F.col("twice"))).join(
            failed, "row", "left_anti").groupBy("row").agg(F.sum("n").alias("n_tokens"))
        done = sums if done is None else done.union(sums)
        if failed.isEmpty():
            return done
        rest = chunks.join(failed, "row", "left_semi")
        if lead < most:
            chunks, lead = stored(rest, "chunks"), min(most, lead * GROWTH)
            continue
        begins = F.coalesce(~F.col("apart"), F.lit(True)).cast("int")
        joint = rest.join(met.select("row", "number", "apart"), ["row", "number"], "left").withColumn(
            "joint", F.sum(begins).over(Window.partitionBy("row").orderBy("number")) - 1)
        parts = F.array_sort(F.collect_list(F.struct("number", "at", "core")))
        chunks = stored(joint.groupBy("row", "joint").agg(parts.alias("parts")).select(
            "row", F.col("joint").alias("number"), F.col("parts")[0]["at"].alias("at"),
            F.array_join(F.col("parts")["core"], "").alias("core")), "chunks")


def token_counts(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, lead: int = LEAD,
                 limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Tokens are those of the piece model at `path`, as its library gives them, without
    begin, end or added tokens; null and empty texts have none. Texts of more than `chunk`
    characters are dealt out in chunks of that length and give the same count. A model
    that does not merge pieces by score, or changes characters, has all its texts encoded
    whole. Repeated rows and null ids each give their row; other columns are ignored; an
    empty table gives an empty result.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    own = own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    cut = stored(own.mapInArrow(_counted_or_cut(path, chunk), _CUT), "cut")
    chunks = cut.where("core IS NOT NULL").select("row", "number", "at", "core")
    texts = cut.where("core IS NULL").select("doc_id", "n_bytes", "n_tokens", "row")
    long = texts.where("n_tokens IS NULL").drop("n_tokens").join(
        spliced(chunks, path, lead, chunk), "row").select("doc_id", "n_bytes", "n_tokens")
    return texts.where("n_tokens IS NOT NULL").select("doc_id", "n_bytes", "n_tokens").union(
        long).withColumn("over_limit", F.col("n_tokens") > limit)
