"""Conversation structure repair by aligning turns to the strings of a grammar.

Role initials of a repaired conversation match ``(s?(ua)+)?``.  A conversation's turns
are aligned (Wagner-Fischer) with the grammar's string of every feasible length; the
incumbent's cost rules out lengths and bounds the table around its diagonal (Ukkonen).
Of the cheapest edits, those with the least audit are taken, as read off the tables.

A long conversation is aligned a ``CHUNK`` of turns at a time, from and to each state
of the grammar, so memory is bounded by the audit itself; a shorter one is one chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import saved

# Costs of edits, and what a truncated turn adds unless it is deleted.
RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

ROLES = {"u": "user", "a": "assistant"}
INITIALS = "sua"
#: Grammar states: nothing yet, and after each initial.
BEGIN, STATES = 0, {"s": 1, "u": 2, "a": 3}
FINAL = (BEGIN, STATES["a"])
FOLLOWS = {BEGIN: "u", 1: "u", 2: "a", 3: "u"}
LEGAL = ("su", "ua", "au")

#: Turns aligned at a time.
CHUNK = 64
#: Different sequences of turns whose alignment a worker remembers.
REMEMBERED = 1 << 15
#: Edits, or characters of their texts, given to Spark at a time.
ROWS_OUT, CHARS_OUT = 4096, 1 << 22

WHITE = " \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- one alignment


def align_to(rows: str, target: str, limit: int) -> tuple[int, str] | None:
    """The cheapest edits of ``rows`` into ``target``, the least audit of them; None if dearer than ``limit``.

    A row is an initial, in capitals if truncated, or ``-`` if it must go.
    """
    n, m = len(rows), len(target)
    forced = rows.count("-")
    offset = m - (n - forced)
    spare = limit - DELETE * forced - (INSERT * offset if offset > 0 else -DELETE * offset)
    if spare < 0:
        return None
    slack = spare // (INSERT + DELETE)  # detours beyond the diagonals that must be crossed
    low, high = min(0, offset) - slack, max(0, offset) + slack
    far = limit + 1
    table: list[list[int]] = [[]] * (n + 1)
    kept = n - forced
    for i in range(n, -1, -1):
        if i < n and rows[i] != "-":
            kept -= 1
        below, cost = table[i + 1] if i < n else None, [far] * (m + 2)
        row = rows[i] if i < n else "-"
        here = row.lower()
        extra = TRUNCATED if row.isupper() else 0
        for j in range(min(m, kept + high), max(0, kept + low) - 1, -1):
            if i == n and j == m:
                cost[j] = 0
                continue
            best = far
            if j < m and target[j] != "s":
                best = INSERT + cost[j + 1]
            if below is not None:
                best = min(best, DELETE + below[j])
                if row != "-" and j < m:
                    step = 0 if here == target[j] else RE_ROLE if target[j] != "s" else far
                    best = min(best, step + extra + below[j + 1])
            cost[j] = min(best, far)
        table[i] = cost
    if table[0][0] > limit:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:  # the least letter of an optimal move: D, I, K, R
        left = table[i][j]
        row = rows[i] if i < n else "-"
        extra = TRUNCATED if row.isupper() else 0
        if i < n and left == DELETE + table[i + 1][j]:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and left == INSERT + table[i][j + 1]:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if row.lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return table[0][0], "".join(audit)


def targets(start: int, end: int, longest: int) -> Iterator[str]:
    """The strings that lead from one state of the grammar to another, up to a length."""
    if start == end:
        yield ""
    if start == BEGIN and end == STATES["s"]:
        yield "s"
    heads = ("", "s") if start == BEGIN else ("",)
    for head in heads:
        state, text = STATES["s"] if head else start, head
        while len(text) < longest:
            text += FOLLOWS[state]
            state = STATES[text[-1]]
            if state == end:
                yield text


@lru_cache(maxsize=REMEMBERED)
def align(rows: str, start: int, last: bool) -> dict[int, tuple[int, str]]:
    """For each state that can be reached from ``start`` (those that may end it, if ``last``): cost and least audit."""
    found = {}
    kept = len(rows) - rows.count("-")
    for end in FINAL if last else (BEGIN, *STATES.values()):
        if start != BEGIN and end in (BEGIN, STATES["s"]) and end != start:
            continue
        # everything deleted, and the shortest string inserted
        bound = DELETE * len(rows) + INSERT * 3
        incumbent: tuple[int, str] | None = None
        feasible = targets(start, end, kept + (bound - DELETE * (len(rows) - kept)) // INSERT)
        for target in sorted(feasible, key=lambda t: abs(len(t) - kept)):
            one = align_to(rows, target, bound)
            if one and (incumbent is None or one < incumbent):
                incumbent, bound = one, one[0]
        if incumbent:
            found[end] = incumbent
    return found


class Aligner:
    """A conversation's cheapest repair, its turns given in order.

    For each state only the cost and the audit's place among the others are carried:
    audits are grouped by a common beginning, groups are in ASCII order, and ``rest`` is
    what an audit has beyond its group's (insertions only, for all took the same turns).
    """

    def __init__(self) -> None:
        self.waiting = ""
        self.best: dict[int, tuple[int, int, str]] = {BEGIN: (0, 0, "")}  # cost, group, rest
        self.trail: list[dict[int, tuple[int, str]]] = []  # by chunk: the state before and the edits since

    def feed(self, rows: str) -> None:
        self.waiting += rows
        while len(self.waiting) > CHUNK:
            self._step(self.waiting[:CHUNK], False)
            self.waiting = self.waiting[CHUNK:]

    def _step(self, rows: str, last: bool) -> None:
        after: dict[int, tuple[int, int, str]] = {}
        came: dict[int, tuple[int, str]] = {}
        for start, (cost, group, rest) in self.best.items():
            for end, (more, tail) in align(rows, start, last).items():
                one = (cost + more, group, rest + tail)
                if end not in after or one < after[end]:
                    after[end], came[end] = one, (start, tail)
        self.trail.append(came)
        self.best, groups, base = {}, 0, None
        for end, (cost, group, text) in sorted(after.items(), key=lambda x: x[1][1:]):
            if base is None or group != base[0] or not text.startswith(base[1]):
                base, groups = (group, text), groups + 1
            self.best[end] = (cost, groups, text[len(base[1]) :])

    def finish(self) -> tuple[int, str]:
        self._step(self.waiting, True)
        (cost, _, _), end = min((place, end) for end, place in self.best.items())
        pieces = []
        for came in reversed(self.trail):
            end, tail = came[end]
            pieces.append(tail)
        return cost, "".join(reversed(pieces))


# ------------------------------------------------------------------- the tables


def _named(turns: DataFrame) -> DataFrame:
    return turns.withColumn("h", F.xxhash64("text", F.lit(1)))


def checked(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, h, code)`` of ``turns(conv_id, turn, role, text)``; texts stay where they are.

    ``code`` holds the role's initial (0 to 2 for s, u, a; 3 for others) and four
    times the number of the turn's first fault; ``h`` tells texts apart.
    """
    shown = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    code = F.lit(3)
    for i, letter in enumerate(INITIALS):
        code = F.when(initial == letter, i).otherwise(code)
    sound = F.when(shown == "", 1).when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    keys = _named(turns).select("conv_id", "turn", "role", "h", code.alias("initial"), sound.alias("sound"))
    # a hot key here is one row repeated; each task sends one row for it
    firsts = keys.groupBy("conv_id", "role", "h").agg(F.min(F.struct("turn")).alias("first"), F.count("h").alias("times")).where("times > 1")
    firsts = firsts.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("h").alias("_h"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("h") == F.col("_h"))
    known = keys.join(firsts, same, "left")
    # of equal rows in one turn all but one repeat; the stream tells them, as they are neighbours
    came_before = F.col("first").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("first"))
    fault = F.when((F.col("sound") != 1) & came_before, 2).otherwise(F.col("sound"))
    return known.select("conv_id", "turn", "role", "h", (F.col("initial") + 4 * fault).alias("code"))


ORDER = ("conv_id", "turn", "role", "h")


def _runs(keys: list[tuple]) -> Iterator[tuple[int, int]]:
    """Bounds of neighbours with one key."""
    first = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[first]:
            yield first, i
            first = i


def _letters(codes: list[int]) -> str:
    """Rows as ``align_to`` takes them."""
    out = []
    for code in codes:
        fault, initial = divmod(code, 4)
        letter = (INITIALS + "o")[initial]
        out.append("-" if fault in (1, 2) else letter.upper() if fault == 3 else letter)
    return "".join(out)


def plans(turns: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of each conversation of ``checked`` turns."""
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, out = False, []
        conv = aligner = before = least = most = last_turn = None
        counts, pairs, distinct, initial = [0] * 4, 0, 0, ""

        def close() -> None:
            cost, audit = aligner.finish()
            gaps = most - least + 1 - distinct if least is not None else 0
            out.append((conv, gaps, *counts[1:], pairs, cost, audit))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()]
            made = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, columns)

        for batch in batches:
            ids, turn, role, h, codes = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "h", "code"))
            for a, b in _runs(ids):
                if not open_ or conv != ids[a]:
                    if open_:
                        close()
                    open_, conv, aligner, before = True, ids[a], Aligner(), None
                    least = most = last_turn = None
                    counts, pairs, distinct, initial = [0] * 4, 0, 0, ""
                own = codes[a:b]
                for i in range(a, b):
                    here = (turn[i], role[i], h[i])
                    if here == before and own[i - a] // 4 != 1:
                        own[i - a] = 8 + own[i - a] % 4
                    before = here
                    counts[own[i - a] // 4] += 1
                    if turn[i] is not None:
                        least = turn[i] if least is None else least
                        distinct += turn[i] != last_turn
                        most = last_turn = turn[i]
                initials = initial + "".join((INITIALS + "o")[c % 4] for c in own)
                pairs += len(initials) - 1 - sum(map(initials.count, LEGAL))
                initial = initials[-1]
                aligner.feed(_letters(own))
            yield flush()
        if open_:
            close()
            yield flush()

    kinds = ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in columns)
    return turns.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(read, kinds)


def edits(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Every edit of every conversation, in order: ``(conv_id, step, edit, turn, role, text)``.

    Roles are those after the repair; deleted turns (edit D) keep theirs, inserted
    ones have no turn and an empty text.  A conversation's edits are neighbours.
    """
    columns = ["conv_id", "step", "edit", "turn", "role", "text"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, step, state, conv, out, chars = "", 0, BEGIN, None, [], 0

        def flush() -> pa.RecordBatch:
            made = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, columns)

        def insert() -> None:
            nonlocal step, state
            while step < len(audit) and audit[step] == "I":
                letter = FOLLOWS[state]
                out.append((conv, step, "I", None, ROLES[letter], ""))
                step, state = step + 1, STATES[letter]

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "audit")), strict=True)
            for conv_id, turn, role, text, plan in rows:
                if plan is not None:
                    audit, step, state, conv = plan, 0, BEGIN, conv_id
                else:
                    edit = audit[step]
                    if edit == "R":
                        role = ROLES[FOLLOWS[state]]
                    out.append((conv, step, edit, turn, role, text))
                    step, chars = step + 1, chars + len(text)
                    if edit != "D":
                        state = STATES[role[0]]
                insert()
                if len(out) >= ROWS_OUT or chars >= CHARS_OUT:
                    yield flush()
                    chars = 0
            if out:
                yield flush()

    nothing = {c: F.lit(None).cast(kind) for c, kind in (("turn", "long"), ("role", "string"), ("text", "string"), ("h", "long"))}
    heads = found.select("conv_id", F.lit(0).alias("kind"), *[v.alias(c) for c, v in nothing.items()], "audit")
    bodies = _named(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "h", F.lit(None).cast("string").alias("audit"))
    return (
        heads.union(bodies).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER[1:])
        .mapInArrow(apply, "conv_id long, step long, edit string, turn long, role string, text string")
    )


def digests(made: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of ``edits``: the repaired ``role:text`` joined by line ends, as they stream by."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, first = None, None, True

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

        for batch in batches:
            for conv_id, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text")), strict=True):
                if state is None or conv_id != conv:
                    if state is not None:
                        yield row()
                    conv, state, first = conv_id, hashlib.sha256(), True
                if edit != "D":
                    state.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
        if state is not None:
            yield row()

    return made.mapInArrow(read, "conv_id long, repaired_sha256 string")


def as_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with a space for a null role or text; other columns are ignored."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
    )


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with a fifth of them damaged, as told by a checksum of ``conv_id:turn`` (null: a space)."""
    name: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    marked = turns.withColumn("_kind", F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20).where("_kind <> 0")
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans and edits of ``conversations(conv_id, turn, role, text)``.

    Plans: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``, a row a
    conversation.  Edits: ``conv_id, step, edit, turn, role, text`` (see ``edits``); the
    repaired conversations are those not of edit D, in order of ``step``.

    Turns are taken in ascending order, null first; those of one turn by role, then by
    a hash of the text.  A turn's first fault counts: blank (no character but white
    space), duplicate (its role and text came earlier), truncated (its last such
    character is none of ``.!?``).  A null role or text is one space, rows without
    conv_id are one conversation, an empty table gives none, other columns are ignored.
    """
    turns = as_turns(conversations)
    found = saved(plans(checked(turns)), "plans")
    return found, edits(turns, found)


def repair_sql() -> str:
    """The damaged ``conversations`` repaired in DuckDB's SQL, a turn at a time with the best plan for each last initial.

    Turns with one number go by role, then by text; for small tables.
    """
    return f"""
with recursive named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name
  from conversations
),
marked as (
  select *, (4294967295 - list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(name, ''),
             lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end)) % 20 as kind
  from named
),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from marked, generate_series(1, case when kind = 3 then 2 else 1 end) where kind <> 0
),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as nth,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as shown,
         case when substr(role, 1, 1) in ('s', 'u', 'a') then substr(role, 1, 1) else 'o' end as letter
  from damaged
),
judged as (
  select *, case when shown = '' then 1 when row_number() over (partition by conv_id, role, text order by nth) > 1 then 2 when right(shown, 1) not in ('.', '!', '?') then 3 else 0 end as fault,
         coalesce(lag(substr(role, 1, 1)) over (partition by conv_id order by nth) || substr(role, 1, 1) not in ('su', 'ua', 'au'), false) as illegal
  from numbered
),
best(conv_id, nth, state, plan) as (
  select conv_id, 0::bigint, state, plan
  from (select distinct conv_id from damaged),
       (values ('', {{'cost': 0::bigint, 'audit': '', 'made': ''}}),
               ('u', {{'cost': {INSERT}, 'audit': 'I', 'made': chr(10) || 'user:'}}),
               ('a', {{'cost': {2 * INSERT}, 'audit': 'II', 'made': chr(10) || 'user:' || chr(10) || 'assistant:'}})) v(state, plan)
  union all
  select conv_id, nth, case when k = 0 then reached when (reached = 'u') = (k = 1) then 'a' else 'u' end,
         min({{'cost': cost + {INSERT} * k, 'audit': audit || repeat('I', k),
               'made': made || case when k = 0 then '' else chr(10) || case when reached = 'u' then 'assistant:' else 'user:' end end
                            || case when k < 2 then '' else chr(10) || case when reached = 'u' then 'user:' else 'assistant:' end end}})
  from (
    select b.conv_id, r.nth, case when move = 'D' then state else move end as reached,
           plan.cost + case when move = 'D' then {DELETE} else (case when move = letter then 0 else {RE_ROLE} end)
                       + (case when fault = 3 then {TRUNCATED} else 0 end) end as cost,
           plan.audit || case when move = 'D' then 'D' when move = letter then 'K' else 'R' end as audit,
           plan.made || case when move = 'D' then '' else chr(10)
             || case when move = letter then role when move = 'u' then 'user' else 'assistant' end || ':' || text end as made
    from best b join judged r on r.conv_id is not distinct from b.conv_id and r.nth = b.nth + 1, (values ('D'), ('s'), ('u'), ('a')) m(move)
    where move = 'D' or (fault not in (1, 2) and (move <> 's' or letter = 's')
                         and state || move in ('s', 'u', 'su', 'ua', 'au'))
  ), (values (0), (1), (2)) i(k)
  group by all
),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank,
         count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated, count(*) filter (illegal) as illegal, count(*) as n
  from judged group by conv_id
),
ended as (
  select b.conv_id, min(plan) as plan from best b join counts c on c.conv_id is not distinct from b.conv_id and b.nth = n
  where state in ('', 'a') group by b.conv_id
)
select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(plan.cost, 0) as cost,
       coalesce(plan.audit, '') as audit, sha256(substr(coalesce(plan.made, ''), 2)) as repaired_sha256
from (select distinct conv_id from conversations) i
left join counts c on c.conv_id is not distinct from i.conv_id
left join ended e on e.conv_id is not distinct from i.conv_id"""
