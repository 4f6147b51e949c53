"""The live path: per-chat buffers, triggers and query caches as keyed state.

A chat's rows meet one state at a time, which is what the write lock of a
single-process host achieves; different chats run in parallel. The state of a
chat is bounded: fewer turns than the threshold plus one micro-batch, and at most
``cache_cap`` keys per cache. Lifecycles that a stream changed are single keys of a map
on disk, read and written only where a row names them; those it started from lie in parts
of a bounded size, one call each, of which a row's is read.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rememora.functions.text import exact_key, token_key
from rememora.params import DEFAULTS, Params
from rememora.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# a bound in bytes is asked for after every row, which costs more than the row; the bound in rows of a batch stays
BATCH_LIMIT, NO_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 1)
FIRED = ("chat_id string, fire long, reason string, turns array<long>, "
         "messages array<struct<role:string,content:string>>")
ROUTED = "chat_id string, seq long, tier string, ids array<string>"
LIVED = ("chat_id string, seq long, kind string, fire long, turns array<long>, "
         "messages array<struct<role:string,content:string>>, id string, importance double, access_count long, "
         "update_count long, updated_seq long, added long, rebuild_due boolean")
SEED = ("chat_id string, part string, seq long, id string, importance double, access_count long, update_count long, "
        "turn long, role string, text string, added long, rebuild_due boolean")
NEW_IMPORTANCE = 50.0
# stored entries of a chat that are kept and read together, about
PART_ENTRIES = 64
# chats meet their state by hash in so many groups, whose rows travel together; a stream that began with this number keeps to it
SHARDS = 1024
# entries of a chat that it starts from travel in pieces of so many at most
PIECE = 512


@contextmanager
def keyed_state(spark: SparkSession):
    """Arbitrary state needs the RocksDB provider while a query starts and runs."""
    wanted = {PROVIDER: ROCKSDB, BATCH_LIMIT: NO_LIMIT}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The chat's rows of one micro-batch by arrival number."""
    frames = list(frames)
    rows = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    return rows if rows["seq"].is_monotonic_increasing else rows.sort_values("seq", kind="stable")


class BufferProcessor(StatefulProcessor):
    """Working buffer of one chat.

    Input operations: ``message`` appends, ``delete`` and ``swipe`` retract the turn
    (a swipe is activity, a deletion is not), ``switch`` leaves the chat. A full
    buffer fires and drains one batch; so does leaving a chat with a full buffer,
    and an idle timeout with any. A retraction without a turn changes nothing.
    """

    def __init__(self, threshold: int, batch: int, idle_ms: int | None):
        self.threshold, self.batch, self.idle_ms = threshold, batch, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "turn long, role string, content string")
        self.fires = handle.getValueState("fires", "n long")

    def _number(self) -> int:
        number = self.fires.get()[0] if self.fires.exists() else 0
        self.fires.update((number + 1,))
        return number

    def _drain(self, key, held, reason, out):
        taken, rest = held[:self.batch], held[self.batch:]
        out.append((key, self._number(), reason, [t for t, _, _ in taken],
                    [{"role": r, "content": c} for _, r, c in taken]))
        return rest

    def _store(self, held):
        self.buffer.clear()
        if held:
            self.buffer.put(held)

    def _rearm(self, timers, active: bool):
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if active:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    @staticmethod
    def _emit(out):
        return iter([pd.DataFrame(out, columns=["chat_id", "fire", "reason", "turns", "messages"])]) if out else iter(())

    def _apply(self, key, row, held, out) -> tuple[list, bool | None]:
        """Buffer after one row, and whether the timer runs on (None: as before)."""
        if row.op == "message" and isinstance(row.text, str) and row.text.strip():
            held.append((None if pd.isna(row.turn) else int(row.turn), row.role, row.text))
            return (self._drain(key, held, "buffer", out) if len(held) >= self.threshold else held), True
        if row.op in ("delete", "swipe"):
            if not pd.isna(row.turn):
                held = [h for h in held if h[0] != int(row.turn)]
            return held, True if row.op == "swipe" else None
        if row.op == "switch":
            return (self._drain(key, held, "buffer", out) if len(held) >= self.threshold else held), False
        return held, None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.buffer.get()]
        out: list[tuple] = []
        armed = None
        for row in _in_order(rows).itertuples(index=False):
            held, said = self._apply(key[0], row, held, out)
            armed = armed if said is None else said
        self._store(held)
        if self.idle_ms is not None and armed is not None:
            self._rearm(timerValues, armed and bool(held))
        return self._emit(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.buffer.get()]
        out: list[tuple] = []
        if held:
            self._store(self._drain(key[0], held, "idle", out))
        return self._emit(out)

    def close(self) -> None:
        pass


def fired_batches(events: DataFrame, params: Params = DEFAULTS, idle: bool = False) -> DataFrame:
    """Batches fired by a stream ``(chat_id, seq, op, turn, role, text)``."""
    processor = BufferProcessor(params.buffer_threshold, params.batch_size,
                                params.idle_seconds * 1000 if idle else None)
    chats = events.select(F.col("chat_id").cast("string").alias("chat_id"), "seq", "op", "turn", "role", "text")
    return chats.groupBy("chat_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=FIRED, outputMode="Append",
        timeMode="ProcessingTime" if idle else "None")


class ChatProcessor(BufferProcessor):
    """Buffer, entry lifecycles and rebuild counter of one chat.

    Besides the buffer's operations: ``access`` and ``update`` raise the importance of entry
    ``id`` up to 100 and count; ``fact`` is a consolidated fact, an update of an entry that is
    held, else a new one, counted since the last rebuild; ``rebuilt`` sets that counter back.
    An operation on an entry that is not held changes nothing and gives no row.
    """

    def __init__(self, params: Params, idle: bool):
        super().__init__(params.buffer_threshold, params.batch_size, params.idle_seconds * 1000 if idle else None)
        self.bonus = {"access": params.access_bonus, "update": params.update_bonus}
        self.suggestion = params.rebuild_suggestion

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.lives = handle.getMapState(
            "lives", "id string", "importance double, accesses long, updates long, updated long")
        # as stored when the stream began, never written again: a later value is in ``lives``
        self.stored = handle.getMapState(
            "stored", "part long", "parts long, ids array<string>, importance array<double>, accesses array<long>, updates array<long>")
        self.rebuild = handle.getValueState("rebuild", "added long, due boolean")
        self.seeded = None

    def handleInitialState(self, key, initialState, timerValues) -> None:
        # most chats hold a few rows, for which plain lists are much cheaper than frames
        columns = ["part", "seq", "id", "importance", "access_count", "update_count", "turn", "role", "text", "added", "rebuild_due"]
        rows = list(zip(*(initialState[c].tolist() for c in columns), strict=True))
        entries = [(r[2], (float(r[3]), int(r[4]), int(r[5]))) for r in rows if r[0] == "entry"]
        if entries:
            if self.seeded == key:
                # a very large chat comes in several frames, and the parts of the first are laid out
                for id, life in entries:
                    self.lives.updateValue((id,), (*life, None))
            else:
                self.seeded, parts = key, math.ceil(len(entries) / PART_ENTRIES)
                held: dict[int, dict] = {0: {}}  # the first part tells how many there are
                for id, life in entries:
                    held.setdefault(zlib.crc32(id.encode()) % parts, {})[id] = life
                for part, found in held.items():
                    lists = zip(*found.values(), strict=True) if found else ((), (), ())
                    self.stored.updateValue((part,), (parts, list(found), *map(list, lists)))
        turns = sorted((r for r in rows if r[0] == "turn"), key=lambda r: (pd.isna(r[1]), r[1]))
        if turns:
            self.buffer.appendList([(int(r[6]), r[7], r[8]) for r in turns])
        for row in rows:
            if row[0] == "chat":
                self.rebuild.update((int(row[9]), bool(row[10])))

    def _part(self, part: int, read: dict[int, tuple]) -> tuple[int, dict]:
        """How many stored parts the chat has, and the lifecycles in this one; ``read`` keeps what this micro-batch read."""
        if part not in read:
            stored = self.stored.getValue((part,))
            read[part] = (0, {}) if stored is None else (
                stored[0], {i: (*life, None) for i, *life in zip(*stored[1:], strict=True)})
        return read[part]

    def _life(self, id: str, read: dict[int, tuple]) -> tuple | None:
        """Lifecycle of an entry, None if it is not held."""
        found = self.lives.getValue((id,))
        if found is not None:
            return tuple(found)
        parts, first = self._part(0, read)
        part = zlib.crc32(id.encode()) % parts if parts else 0
        return (self._part(part, read)[1] if part else first).get(id)

    def _count(self, key, seq, row, lives, added, due, out) -> tuple[int, bool, bool]:
        """Rebuild counter after one row, and whether it changed its entry, whose lifecycle ``lives`` holds."""
        if row.op == "rebuilt":
            added, due = 0, False
            out.append((key, seq, "rebuilt") + (None,) * 8 + (added, due))
        if row.op not in ("access", "update", "fact") or not isinstance(row.id, str):
            return added, due, False
        now = lives[row.id]
        kind = "added" if row.op == "fact" and now is None else "update" if row.op == "fact" else row.op
        if kind == "added":
            added, lives[row.id] = added + 1, (NEW_IMPORTANCE, 0, 0, seq)
            due = due or added >= self.suggestion
        elif now is None:
            return added, due, False
        else:
            wrote = kind == "update"
            lives[row.id] = (min(100.0, now[0] + self.bonus[kind]), now[1] + (not wrote), now[2] + wrote,
                             seq if wrote else now[3])
        counter = (added, due) if kind == "added" else (None, None)
        out.append((key, seq, kind, None, None, None, row.id, *lives[row.id], *counter))
        return added, due, True

    def _fired(self, key, seq, fired):
        return [(key, seq, reason, n, turns, messages) + (None,) * 7 for _, n, reason, turns, messages in fired]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.buffer.get()]
        before, counted = list(held), self.rebuild.get()
        added, due = counted if counted is not None else (0, False)
        lives: dict[str, tuple | None] = {}  # entries that this micro-batch names; None: not held
        read: dict[int, tuple] = {}
        changed, out, armed = set(), [], None
        for row in _in_order(rows).itertuples(index=False):
            seq, fired = int(row.seq), []
            held, said = self._apply(key[0], row, held, fired)
            armed = True if row.op == "access" else armed if said is None else said
            out += self._fired(key[0], seq, fired)
            if row.op in ("access", "update", "fact") and isinstance(row.id, str) and row.id not in lives:
                lives[row.id] = self._life(row.id, read)
            added, due, touched = self._count(key[0], seq, row, lives, added, due, out)
            if touched:
                changed.add(row.id)
        if held != before:
            self._store(held)
        if counted is None or (added, due) != tuple(counted):
            self.rebuild.update((added, due))
        for name in changed:
            self.lives.updateValue((name,), lives[name])
        if self.idle_ms is not None and armed is not None:
            self._rearm(timerValues, armed and bool(held))
        return self._emit(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.buffer.get()]
        fired: list[tuple] = []
        if held:
            self._store(self._drain(key[0], held, "idle", fired))
        return self._emit(self._fired(key[0], None, fired))

    @staticmethod
    def _emit(out):
        names = [field.split(" ")[0] for field in LIVED.split(", ")]
        return iter([pd.DataFrame(out, columns=names, dtype=object)]) if out else iter(())


class _Chat:
    """State of one chat during a micro-batch: read in one call, and written in one if it changed.

    It is kept as JSON: a call that converts typed lists costs several times as much.
    Entries lie in parts by linear hashing, the first one beside the rest of the chat's state. A chat gets one part
    more whenever its parts hold twice ``PART_ENTRIES`` on average, so what a row reads does not grow with the chat.
    """

    def __init__(self, states: ShardProcessor, chat: str | None, fresh: bool = False):
        self.states, self.chat = states, chat
        self.name = "" if chat is None else f"={chat}"
        found = None if fresh else states.chats.getValue((self.name,))
        self.fires, self.added, self.due, held, self.count, self.entries, lives = json.loads(found[0]) if found else (0, 0, False, [], 1, 0, {})
        self.held = [tuple(turn) for turn in held]
        self.read: dict[int, dict[str, tuple]] = {0: lives}
        self.stale: set[int] = set()
        self.saved = self._state()

    def _state(self) -> tuple:
        return self.fires, self.added, self.due, list(self.held), self.count, self.entries

    def _at(self, id: str) -> int:
        half = 1 << (self.count.bit_length() - 1)
        at = zlib.crc32(id.encode()) % (2 * half)
        return at if at < self.count else at - half

    def part(self, at: int) -> dict[str, tuple]:
        if at not in self.read:
            found = self.states.parts.getValue((self.name, at))
            self.read[at] = {} if found is None else json.loads(found[0])
        return self.read[at]

    def life(self, id: str) -> tuple | None:
        """Lifecycle of an entry, None if it is not held."""
        return self.part(self._at(id)).get(id)

    def put(self, id: str, life: tuple) -> None:
        at = self._at(id)
        part = self.part(at)
        self.entries += id not in part
        part[id] = life
        self.stale.add(at)
        if self.entries > 2 * PART_ENTRIES * self.count:
            split = self.count - (1 << (self.count.bit_length() - 1))
            old, self.count = self.part(split), self.count + 1
            self.read[self.count - 1] = {i: old.pop(i) for i in [i for i in old if self._at(i) != split]}
            self.stale |= {split, self.count - 1}

    def save(self) -> None:
        for at in self.stale - {0}:
            self.states.parts.updateValue((self.name, at), (json.dumps(self.read[at]),))
        if 0 in self.stale or self._state() != self.saved:
            self.states.chats.updateValue((self.name,), (json.dumps((*self._state(), self.read[0])),))


class ShardProcessor(ChatProcessor):
    """:class:`ChatProcessor` for the chats of one shard, which keep their states apart; without timers.

    Rows, stored ones too, come and go as frames of a shard: a frame and the calls around it cost
    more than a short chat's own work.
    """

    def __init__(self, params: Params):
        super().__init__(params, False)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chats = handle.getMapState("chats", "chat string", "state string")
        self.parts = handle.getMapState("parts", "chat string, part long", "entries string")
        self.now: _Chat | None = None
        self.shard, self.begun = None, set()

    def _number(self) -> int:
        self.now.fires += 1
        return self.now.fires - 1

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if self.shard != key:
            self.shard, self.begun = key, set()
        for row in initialState.itertuples(index=False):
            # a very large chat comes in several pieces
            chat = _Chat(self, row.chat_id, fresh=row.chat_id not in self.begun)
            if row.chat_id not in self.begun:
                self.begun.add(row.chat_id)
                chat.count = max(1, math.ceil(len(row.ids) / PART_ENTRIES))
                chat.read |= {at: {} for at in range(1, chat.count)}
                chat.stale |= {0}
            for id, importance, accesses, updates in zip(row.ids, row.importance, row.accesses, row.updates, strict=True):
                chat.put(id, (float(importance), int(accesses), int(updates), None))
            chat.held += [(int(t), r, c) for t, r, c in zip(row.turns, row.roles, row.contents, strict=True)]
            if len(row.added):
                chat.added, chat.due = int(row.added[-1]), bool(row.due[-1])
            chat.save()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chats: dict[str | None, _Chat] = {}
        out: list[tuple] = []
        for row in _in_order(rows).itertuples(index=False):
            name = row.chat_id if isinstance(row.chat_id, str) else None
            if name not in chats:
                chats[name] = _Chat(self, name)
            now = self.now = chats[name]
            seq, fired = int(row.seq), []
            now.held = self._apply(name, row, now.held, fired)[0]
            out += self._fired(name, seq, fired)
            named = row.op in ("access", "update", "fact") and isinstance(row.id, str)
            lives = {row.id: now.life(row.id)} if named else {}
            now.added, now.due, touched = self._count(name, seq, row, lives, now.added, now.due, out)
            if touched:
                now.put(row.id, lives[row.id])
        for chat in chats.values():
            chat.save()
        return self._emit(out)


def _shard():
    return F.pmod(F.crc32(F.coalesce("chat_id", F.lit(""))), F.lit(SHARDS)).cast("int").alias("shard")


def _pieces(stored: DataFrame) -> DataFrame:
    """The rows of :func:`stored_state` as lists, a row per chat and piece of its entries; buffered turns lie in the first in their order."""
    ahead = Window.partitionBy("chat_id").orderBy(F.desc("part"), F.asc_nulls_last("seq"), "id")
    at = stored.withColumn("at", F.row_number().over(ahead)).withColumn(
        "piece", F.when(F.col("part") == "entry", F.floor(F.col("at") / PIECE)).otherwise(0))
    kept = ["at", "id", "importance", "access_count", "update_count", "turn", "role", "text", "added", "rebuild_due"]

    def listed(part):
        return F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct(*kept)))).alias(part)

    lists = at.groupBy("chat_id", "piece").agg(*[listed(part) for part in ("entry", "turn", "chat")])
    names = {"entry": {"id": "ids", "importance": "importance", "access_count": "accesses", "update_count": "updates"},
             "turn": {"turn": "turns", "role": "roles", "text": "contents"}, "chat": {"added": "added", "rebuild_due": "due"}}
    return lists.select(_shard(), "chat_id", *[F.col(f"{part}.{c}").alias(n) for part, found in names.items() for c, n in found.items()])


def stored_state(entries: DataFrame, turns: DataFrame | None = None, chats: DataFrame | None = None) -> DataFrame:
    """What a stream starts from: stored ``entries(chat_id, id, importance, access_count, update_count)``,
    buffered ``turns(chat_id, seq, turn, role, text)``, ``chats(chat_id, added, rebuild_due)``.

    Nulls become zero or false; an entry without an id and a row without a chat are left out.
    """
    parts = [entries.filter("id IS NOT NULL").withColumn("part", F.lit("entry"))]
    parts += [d.withColumn("part", F.lit(p)) for d, p in ((turns, "turn"), (chats, "chat")) if d is not None]
    shape = [field.split(" ") for field in SEED.split(", ")]
    zero = {"importance": 0.0, "access_count": 0, "update_count": 0, "added": 0, "rebuild_due": False, "turn": -1}
    rows = None
    for part in parts:
        columns = [(F.coalesce(F.col(n).cast(t), F.lit(zero[n])) if n in zero else F.col(n).cast(t)).alias(n)
                   if n in part.columns else F.lit(zero.get(n)).cast(t).alias(n) for n, t in shape]
        rows = part.select(columns) if rows is None else rows.unionByName(part.select(columns))
    return rows.filter("chat_id IS NOT NULL")


def lived(events: DataFrame, stored: DataFrame | None = None, params: Params = DEFAULTS, idle: bool = False) -> DataFrame:
    """Fired batches and lifecycle changes of a stream ``(chat_id, seq, op, turn, role, text, id)``.

    ``stored`` (see :func:`stored_state`) is read once, when the stream first starts.
    """
    chats = events.select(F.col("chat_id").cast("string").alias("chat_id"), "seq", "op", "turn", "role", "text", "id")
    if idle:  # a timer belongs to a key, so each chat is one
        return chats.groupBy("chat_id").transformWithStateInPandas(
            statefulProcessor=ChatProcessor(params, idle), outputStructType=LIVED, outputMode="Append", timeMode="ProcessingTime",
            initialState=None if stored is None else stored.groupBy("chat_id"))
    return chats.select(_shard(), "*").groupBy("shard").transformWithStateInPandas(
        statefulProcessor=ShardProcessor(params), outputStructType=LIVED, outputMode="Append", timeMode="None",
        initialState=None if stored is None else _pieces(stored).groupBy("shard"))


class _Recent:
    """One cache of a chat, read once per micro-batch: keys oldest write first, eviction in constant time."""

    def __init__(self, state, cap: int):
        self.state, self.cap = state, cap
        self.rows: OrderedDict[str, tuple[list, int]] | None = None
        self.stored: set[str] = set()
        self.changed: set[str] = set()

    def load(self) -> OrderedDict:
        if self.rows is None:
            found = sorted(((k[0], (list(v[0]), v[1])) for k, v in self.state.iterator()), key=lambda r: r[1][1])
            self.rows = OrderedDict(found)
            self.stored = set(self.rows)
        return self.rows

    def record(self, key: str, ids: list, at: int) -> list[str]:
        """Write a key to the end and return those that fall out."""
        rows = self.load()
        rows.pop(key, None)
        rows[key] = (list(ids), at)
        out = [rows.popitem(last=False)[0] for _ in range(len(rows) - self.cap)]
        self.changed.update(out, [key])
        return out

    def clear(self) -> None:
        self.state.clear()
        self.rows, self.stored, self.changed = OrderedDict(), set(), set()

    def save(self) -> None:
        for key in self.changed:
            if key in self.rows:
                self.state.updateValue((key,), self.rows[key])
            elif key in self.stored:
                self.state.removeKey((key,))


class _Similar:
    """Keys of a cache by the tokens of their prefix; sets of Jaccard ``threshold`` or more share one of these."""

    def __init__(self, cache: _Recent, threshold: float):
        self.cache, self.threshold = cache, threshold
        self.holders: dict[str, set[str]] | None = None

    def prefix(self, key: str) -> list[str]:
        tokens = key.split(" ")
        return tokens[:len(tokens) - math.ceil(self.threshold * len(tokens) - 1e-9) + 1]

    def add(self, key: str) -> None:
        for token in self.prefix(key):
            self.holders[token].add(key)

    def record(self, key: str, ids: list, at: int) -> None:
        fallen = self.cache.record(key, ids, at)
        if self.holders is not None:
            self.add(key)
            for old in fallen:
                for token in self.prefix(old):
                    self.holders[token].discard(old)

    def nearest(self, key: str) -> list | None:
        """Ids of the most similar key at or above the threshold, the oldest write among equals."""
        rows = self.cache.load()
        if self.holders is None:
            self.holders = defaultdict(set)
            for held in rows:
                self.add(held)
        tokens, best = set(key.split(" ")), None
        for near in set().union(*(self.holders.get(t, ()) for t in self.prefix(key))):
            other = set(near.split(" "))
            shared = len(tokens & other)
            ranked = (shared / (len(tokens) + len(other) - shared), -rows[near][1])
            if ranked[0] >= self.threshold and (best is None or ranked > best[0]):
                best = (ranked, rows[near][0])
        return best and best[1]


class CacheProcessor(StatefulProcessor):
    """Exact and fuzzy query cache of one chat, oldest write evicted first.

    ``query`` rows carry what the ladder would answer; ``write`` rows mark a
    long-term write, which clears the exact cache only. Empty keys are not stored.
    """

    def __init__(self, cap: int, threshold: float):
        self.cap, self.threshold = cap, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        shape = "ids array<string>, written long"
        self.exact = handle.getMapState("exact", "key string", shape)
        self.fuzzy = handle.getMapState("fuzzy", "key string", shape)
        self.clock = handle.getValueState("clock", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = self.clock.get()[0] if self.clock.exists() else 1
        exact, fuzzy = _Recent(self.exact, self.cap), _Recent(self.fuzzy, self.cap)
        similar = _Similar(fuzzy, self.threshold)
        out = []
        for row in _in_order(rows).itertuples(index=False):
            at += 1
            if row.op == "write":
                exact.clear()
                continue
            stored = exact.load().get(row.exact)
            near = None if stored and stored[0] or not row.fuzzy else similar.nearest(row.fuzzy)
            if stored and stored[0]:
                tier, ids = "0", stored[0]
            elif near is not None:
                tier, ids = "1", near
            else:
                tier, ids = row.tier, list(row.ids) if row.ids is not None else []
            if row.exact and (near is not None or tier == "3"):
                exact.record(row.exact, ids, at)
            if row.fuzzy and near is None and tier == "3":
                similar.record(row.fuzzy, ids, at)
            out.append((key[0], row.seq, tier, list(ids)))
        exact.save()
        fuzzy.save()
        self.clock.update((at,))
        if out:
            yield pd.DataFrame(out, columns=["chat_id", "seq", "tier", "ids"])

    def close(self) -> None:
        pass


def routed_queries(events: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Tier that answers each query of a stream ``(chat_id, seq, op, query, tier, ids)``."""
    keyed = events.select(
        F.col("chat_id").cast("string").alias("chat_id"), "seq", "op",
        exact_key(F.coalesce("query", F.lit(""))).alias("exact"), token_key(F.col("query")).alias("fuzzy"), "tier", "ids")
    return keyed.groupBy("chat_id").transformWithStateInPandas(
        statefulProcessor=CacheProcessor(params.cache_cap, params.fuzzy_threshold),
        outputStructType=ROUTED, outputMode="Append", timeMode="None")


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over everything that is there now and return what it wrote."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    with keyed_state(spark):
        running = (stream.writeStream.format("parquet").outputMode("append")
                   .option("path", out).option("checkpointLocation", scratch_path(spark, f"{label}-progress"))
                   .trigger(availableNow=True).start())
        running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
