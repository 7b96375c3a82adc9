"""Hidden Markov states by Viterbi decoding of bounded chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import columns as C
from ..core import MissingColumns, Transformer
from ..model import HmmModel


#: About so many values are decoded together.
TOGETHER = 65536


def decoded(model: HmmModel, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The likeliest states, as numbers, of sequences of such lengths that lie one after another in ``values``; -1 throughout one that no states can make.

    All sequences take each step together, the longest first.  A value on an edge falls into the bin above it.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        start = np.log([model.initial[s] for s in model.states])
        step = np.log([[model.transition[a][b] for b in model.states] for a in model.states])
        emit = np.log([model.emission[s] for s in model.states]).T
    emit = np.vstack([emit, np.full((max(0, len(model.edges) + 1 - len(emit)), len(start)), -np.inf)])  # a bin without a probability
    bins = np.searchsorted(model.edges, values, side="right")
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")  # how many are longer than t
    score, back = start + emit[bins[first]], [None]
    for t, n in enumerate(active[1:].tolist(), 1):
        moves = score[:n, :, None] + step
        back.append(moves.argmax(1).astype(np.min_scalar_type(len(start))))
        score[:n] = moves.max(1) + emit[bins[first[:n] + t]]
    now, path = score.argmax(1), np.empty(len(values), int)
    impossible = ~np.isfinite(score[np.arange(len(now)), now])
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        path[first[:n] + t] = now[:n]
        if t:
            now[:n] = back[t][np.arange(n), now[:n]]
    unknown = np.empty(len(lengths), bool)
    unknown[order] = impossible
    path[np.repeat(unknown, lengths)] = -1
    return path


def viterbi(model: HmmModel, values: np.ndarray) -> list[str]:
    """The likeliest states for a sequence of values."""
    path = decoded(model, np.asarray(values), np.array([len(values)]))
    if -1 in path:
        raise ValueError("no sequence of states can make these values")
    return [model.states[k] for k in path]


def _row_states(model: HmmModel, values: np.ndarray, sizes: np.ndarray | None, lengths: np.ndarray) -> pa.Array:
    """The state of each row, of ``sizes`` values (none given: one), in chunks of so many rows."""
    rows = int(lengths.sum())
    owner = np.repeat(np.arange(rows), 1 if sizes is None else sizes)
    chunk = np.repeat(np.arange(len(lengths)), lengths)[owner]
    try:
        path = decoded(model, values, np.bincount(chunk, minlength=len(lengths)))
    except (ValueError, KeyError, IndexError):
        return pa.array([C.UNKNOWN] * rows, pa.string())
    named = sorted(range(len(model.states)), key=lambda k: model.states[k])
    names = np.array([C.UNKNOWN, *(model.states[k] for k in named)], object)
    if sizes is None:
        place = np.zeros(len(named) + 1, int)
        place[named] = np.arange(1, len(named) + 1)  # -1 is the last: Unknown
        return pa.array(names[place[path]], pa.string())
    votes = np.bincount(owner * (len(named) + 1) + path + 1, minlength=rows * (len(named) + 1)).reshape(rows, -1)
    return pa.array(names[votes[:, [0, *(k + 1 for k in named)]].argmax(1)], pa.string())


class HmmStates(Transformer):
    """The state of each row from a scalar or an array of scalars, decoded in chunks of at most ``chunk`` rows.

    Chunks bound the memory of a task.  Null scalars count as 0; of an array the
    state most of its values get (ties: the first by name) is the row's, and an
    empty or null one counts as a 0.  A chunk that can't be decoded is
    ``Unknown`` throughout.
    """

    def __init__(self, source: str, model: HmmModel, partition: str, target: str, order: str = C.TIMESTAMP, chunk: int = 5000) -> None:
        self.source, self.model, self.partition, self.target, self.order, self.chunk = source, model, partition, target, order, chunk

    def required(self) -> list[str]:
        return [self.partition, self.order]

    def build(self, df: DataFrame) -> DataFrame:
        if self.source not in df.columns:
            raise MissingColumns(f"Missing required column {self.source} to compute HMM")
        model, source, target, order = self.model, self.source, self.target, self.order
        w = W.partitionBy(self.partition).orderBy(order)
        n = F.row_number().over(w) - 1
        chunked = df.withColumn("__n", n).withColumns({"__chunk": F.floor(F.col("__n") / self.chunk), "__n": F.col("__n") % self.chunk})

        def decode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            begins, values, sizes, held = [], [], [], 0

            def flush(rows: int) -> pa.Array:
                nonlocal begins, values, sizes, held
                at, flat, size = np.concatenate(begins), np.concatenate(values), np.concatenate(sizes) if sizes else None
                cut = rows if size is None else int(size[:rows].sum())
                lengths = np.diff(np.append(np.flatnonzero(at[:rows]), rows))
                out = _row_states(model, flat[:cut], None if size is None else size[:rows], lengths)
                begins, values, sizes, held = [at[rows:]], [flat[cut:]], [] if size is None else [size[rows:]], len(flat) - cut
                return out

            for place, value in batches:
                begins.append(place.to_numpy(zero_copy_only=False) == 0)
                if pa.types.is_list(value.type):
                    sizes.append(np.diff(value.offsets.to_numpy()))
                    value = value.flatten()
                values.append(value.to_numpy(zero_copy_only=False))
                held += len(values[-1])
                if held >= TOGETHER and len(whole := np.flatnonzero(np.concatenate(begins))) > 1:
                    yield flush(int(whole[-1]))  # the last chunk may go on
            if sum(map(len, begins)):
                yield flush(sum(map(len, begins)))

        plain = lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))
        value = F.col(source)
        if isinstance(df.schema[source].dataType, T.ArrayType):
            value = F.when(F.size(value) > 0, F.transform(value, plain)).otherwise(F.array(F.lit(0.0)))
        else:
            value = plain(value)
        # it hangs on the order of its rows: not to be moved, nor its rows cut short by a limit
        states = F.arrow_udf(decode, T.StringType()).asNondeterministic()
        # dealt by chunk, so that an object with a long history isn't one task; Python gets values only, and columns that nobody reads are never made
        dealt = chunked.repartition(self.partition, "__chunk").sortWithinPartitions(self.partition, "__chunk", "__n")
        out = dealt.withColumn("__state", states(F.col("__n"), value)).where(F.col("__state").isNotNull())
        return out.select(*(f"`{c}`" for c in df.columns if c != target), F.col("__state").alias(target))


class MovingState(HmmStates):
    """Still or moving from a speed; gaps of a gap column stay gaps."""

    def __init__(self, model: HmmModel, id: str = "id", speed: str = C.SPEED, target: str = C.MOVING_STATE, gap: str | None = None, **options) -> None:
        super().__init__(speed, model, id, target, **options)
        self.gap = gap

    def build(self, df: DataFrame) -> DataFrame:
        out = super().build(df)
        return out.withColumn(self.target, F.when(F.col(self.gap) == C.GAP, C.GAP).otherwise(F.col(self.target))) if self.gap else out


class Tempo(HmmStates):
    """The tempo of messages from durations; an unknown one counts as irregular."""

    def __init__(self, model: HmmModel, id: str = "id", duration: str = C.DURATION, target: str = C.TEMPO, irregular: str = C.IRREGULAR, **options) -> None:
        super().__init__(duration, model, id, target, **options)
        self.irregular = irregular

    def build(self, df: DataFrame) -> DataFrame:
        return super().build(df).withColumn(self.target, F.coalesce(self.target, F.lit(self.irregular)))
