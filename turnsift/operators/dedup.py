"""Duplicates, echoes and replaced fragments in ordered conversation logs.

Messages need ``convo_id, seq, ts, platform, role, content``; (convo_id, seq) identifies a
row and (ts, seq) orders a conversation.  Texts travel as digests wherever only equality
matters.  ``scope`` is ``convo`` (default) or ``platform`` (across conversations).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnsift.functions import text as tx
from turnsift.operators.enrich import with_filter_config
from turnsift.plans.greedy import keep_if_quiet
from turnsift.plans.relay import relay
from turnsift.plans.timeline import Timeline

ID = ["convo_id", "seq"]
CONVO_ORDER = ["ts", "seq"]
PLATFORM_ORDER = ["ts", "convo_id", "seq"]


def scope_columns(scope: str) -> list[str]:
    return ["platform", "convo_id"] if scope == "convo" else ["platform"]


def scope_order(scope: str) -> list[str]:
    return CONVO_ORDER if scope == "convo" else PLATFORM_ORDER


def narrow(messages: DataFrame, *extra: str | Column) -> DataFrame:
    """Identity, order and digest of each message."""
    return messages.select(*ID, "ts", "platform", "role", tx.digest(F.col("content")).alias("digest"), *extra)


def seconds_since(earlier: str | Column, ts: str | Column = "ts") -> Column:
    return (F.unix_micros(ts) - F.unix_micros(earlier)) / 1_000_000


def dedup_window_role(messages: DataFrame, scope: str = "platform") -> DataFrame:
    """``kept`` is false within 2 s (assistant) or 5 s (others) of a kept equal message."""
    rows = narrow(messages)
    window = F.when(F.col("role") == "assistant", 2).otherwise(5)
    return keep_if_quiet(rows, [*scope_columns(scope), "role", "digest"], "ts", ID, window)


def dedup_assistant_30s(messages: DataFrame) -> DataFrame:
    """Assistant rows: ``kept`` is false within 30 s of a kept equal text on any platform."""
    rows = narrow(messages.where(F.col("role") == "assistant"))
    return keep_if_quiet(rows, ["role", "digest"], "ts", ID, F.lit(30))


def dedup_messages(
    messages: DataFrame, scope: str = "platform", horizon: int = 3600, historical: str | None = None
) -> DataFrame:
    """The three repeat rules together, as ``kept``.

    A run is a sequence of equal messages without a silence longer than ``horizon``.  Its
    first row is kept, historical rows only then.  Assistant texts stay out for 30 s after
    a kept one, others for 10 s after the first and 5 s after any kept one.
    """
    flag = F.coalesce(F.col(historical), F.lit(False)) if historical else F.lit(False)
    place = F.col("platform") if scope == "platform" else F.concat_ws("/", "platform", "convo_id")
    assistant = F.col("role") == "assistant"
    where = F.when(assistant & (F.lit(scope) == "platform"), F.lit("*")).otherwise(place)
    rows = narrow(messages, flag.alias("historical")).withColumn("place", where)
    keys = ["place", "role", "digest"]
    log = Timeline(rows, keys, PLATFORM_ORDER).scan(prev={"prev_ts": F.col("ts")})
    fresh = F.col("prev_ts").isNull() | (seconds_since("prev_ts") > horizon)
    log = log.columns(fresh=fresh).scan(upto={"run_ts": F.when(F.col("fresh"), F.col("ts"))})
    early = ~assistant & (seconds_since("run_ts") < 10) & ~F.col("fresh")
    ready = log.columns(open=F.col("fresh") | ~(F.col("historical") | early)).result().drop("prev_ts", "run_ts")
    window = F.when(assistant, 30).otherwise(5)
    decided = keep_if_quiet(ready.where("open"), keys, "ts", ID, window, forced=F.col("fresh"))
    out = [*ID, "ts", "platform", "role", "digest", "kept"]
    return decided.select(*out).unionByName(ready.where(~F.col("open")).withColumn("kept", F.lit(False)).select(*out))


def prefix_block(role: Column, content: Column, prefix: str = "J", markers: tuple = ("testmessage", "respond")) -> Column:
    """User texts with a stray leading letter whose clean version is still to come."""
    rest = F.substr(content, F.lit(len(prefix) + 1))
    return (role == "user") & content.startswith(prefix) & (F.length(content) > 10) & tx.contains_any(rest, markers)


def supersede_prefixed(messages: DataFrame, scope: str = "convo", prefix: str = "J") -> DataFrame:
    """``superseded``: the next row is the same user text without the leading letter."""
    rest = tx.digest(F.substr(F.col("content"), F.lit(len(prefix) + 1)))
    rows = narrow(messages, rest.alias("rest"), F.col("content").startswith(prefix).alias("prefixed"))
    following = F.struct("role", "platform", "digest")
    log = Timeline(rows, scope_columns(scope), scope_order(scope)).scan(prev={"next": following}, back=True)
    hit = F.col("prefixed") & (F.col("role") == "user") & (F.col("next.role") == "user")
    hit = hit & (F.col("next.digest") == F.col("rest"))
    return log.columns(superseded=F.coalesce(hit, F.lit(False))).result(*ID, "ts", "platform", "role", "superseded")


def user_echo_label(messages: DataFrame, scope: str = "convo") -> DataFrame:
    """Assistant rows against the last five rows, oldest first: the first hit decides.

    ``exact``: a user row of at most 10 s ago with the same text (noise ``user_input_echo``);
    ``conversational``: a user text of at most 30 s ago contained in this one (allowed).
    Texts already seen from the assistant in this scope get no label.
    """
    lowered = F.lower("content")
    entry = F.struct("ts", "role", tx.strip(F.col("content")).alias("text"), lowered.alias("lowered"))
    rows = messages.select(*ID, "ts", "platform", "role", "content", tx.digest(F.col("content")).alias("digest"))
    log = Timeline(rows, scope_columns(scope), scope_order(scope)).scan(tail={"recent": (entry, 5)})

    def is_exact(e: Column) -> Column:
        return (seconds_since(e["ts"]) <= 10) & (e["text"] == tx.strip(F.col("content")))

    def is_part(e: Column) -> Column:
        return (seconds_since(e["ts"]) <= 30) & F.lower("content").contains(e["lowered"])

    hits = F.filter("recent", lambda e: (e["role"] == "user") & (is_exact(e) | is_part(e)))
    first = F.get(hits, 0)
    label = F.when(is_exact(first), "exact").when(first.isNotNull(), "conversational")
    labelled = log.columns(label=F.when(F.col("role") == "assistant", label)).result(
        *ID, "ts", "platform", "role", "digest", "label"
    )
    seen = Timeline(labelled, [*scope_columns(scope), "role", "digest"], scope_order(scope)).scan(
        prev={"seen": F.col("ts")}
    )
    known = F.col("seen").isNotNull() & (F.col("seen") != F.col("ts"))
    return seen.columns(label=F.when(~known, F.col("label"))).result(*ID, "ts", "platform", "role", "label")


def collapsed_fragments(messages: DataFrame, scope: str = "convo", seconds: int = 5, rows_back: int = 20) -> DataFrame:
    """Identities of streaming fragments that a later, longer assistant row replaces.

    Each row removes at most the oldest fragment among the last ``rows_back`` rows.  A
    prefix is recognised by its length and digest, so earlier texts need not be carried.
    """
    text = F.col("content")
    entry = F.struct("ts", "role", *ID, F.length(text).alias("size"), tx.digest(text).alias("digest"))
    rows = messages.select(*ID, "ts", "platform", "role", "content")
    log = Timeline(rows, scope_columns(scope), scope_order(scope)).scan(tail={"recent": (entry, rows_back)})

    def is_fragment(e: Column) -> Column:
        age = seconds_since(e["ts"])
        near = (e["role"] == "assistant") & (age > 0) & (age <= seconds)
        shorter = (e["size"] >= 3) & (e["size"] < F.length(text))
        return near & shorter & (tx.digest(F.substr(text, F.lit(1), e["size"])) == e["digest"])

    found = log.where(F.col("role") == "assistant").result().select(
        F.get(F.filter("recent", is_fragment), 0).alias("old")
    )
    return found.where("old is not null").select("old.convo_id", "old.seq").distinct()


def stream_prefix_collapse(messages: DataFrame, scope: str = "convo") -> DataFrame:
    """Messages without the fragments that a longer version replaces."""
    return messages.join(collapsed_fragments(messages, scope), ID, "left_anti")


def name_prefix_echo(messages: DataFrame, scope: str = "convo") -> DataFrame:
    """``blocked``: claude assistant rows that repeat a recent user text behind one character."""
    text = F.col("content")
    entry = F.struct("ts", "role", F.length(text).alias("size"), tx.digest(text).alias("digest"))
    rest = tx.digest(F.substr(text, F.lit(2)))
    rows = messages.select(*ID, "ts", "platform", "role", rest.alias("rest"), entry.alias("entry"))
    log = Timeline(rows, scope_columns(scope), scope_order(scope)).scan(tail={"recent": (F.col("entry"), 10)})

    def is_source(e: Column) -> Column:
        return (e["role"] == "user") & (e["size"] >= 10) & (e["digest"] == F.col("rest")) & (seconds_since(e["ts"]) <= 30)

    mine = (F.col("role") == "assistant") & (F.col("platform") == "claude")
    blocked = mine & F.exists("recent", is_source)
    return log.columns(blocked=blocked).result(*ID, "ts", "platform", "role", "blocked")


def recent_history_dedup(messages: DataFrame, rows_back: int = 20) -> DataFrame:
    """Assistant rows: ``kept`` is false if the text is among the last kept ones of the conversation.

    The ``said:`` prefixes do not make a difference.  The ring of kept texts depends on
    every earlier decision, so it is relayed from block to block.
    """
    key = tx.digest(tx.clean_assistant_prefix(F.col("content")))
    rows = messages.where(F.col("role") == "assistant").select(*ID, "ts", key.alias("text_key"))

    def step(state: dict, row: dict) -> dict:
        ring = state.setdefault("ring", [])
        if row["text_key"] in ring:
            return {"kept": False}
        ring.append(row["text_key"])
        del ring[:-rows_back]
        return {"kept": True}

    return relay(rows, ["convo_id"], CONVO_ORDER, step, {"kept": "boolean"}).drop("text_key")


def consecutive_dedup(messages: DataFrame) -> DataFrame:
    """User rows of more than two characters that differ from the user row before."""
    rows = messages.where((F.col("role") == "user") & (F.length("content") > 2))
    rows = rows.withColumn("digest", tx.digest(F.col("content")))
    log = Timeline(rows, ["convo_id"], CONVO_ORDER).scan(prev={"last": F.col("digest")})
    return log.where(~F.col("last").eqNullSafe(F.col("digest"))).result().drop("last", "digest")


def echo_rows(messages: DataFrame, flags: dict[str, Column] | None = None) -> DataFrame:
    """User and assistant rows with what the leading-character check needs, without their text.

    ``probes`` of an assistant row are the digests of its text without its first 0..k
    characters, ``k`` and the greeting exemption coming from the row's ``model``.
    """
    text, lower = F.col("content"), F.lower("content")
    rows = with_filter_config(messages.where(F.col("role").isin("user", "assistant")))
    greeting = tx.contains_any(lower, ["hello", "hi there", "how can i help"])
    probed = (F.col("role") == "assistant") & ~(F.col("allow_greetings") & greeting)
    shifts = F.sequence(F.lit(1), F.col("echo_chars").cast("int") + 1)
    probes = F.when(probed, F.transform(shifts, lambda at: tx.digest(F.substr(text, at))))
    return rows.select(
        *ID, "ts", "platform", "role", "model", tx.digest(text).alias("digest"), probes.alias("probes"),
        *[value.alias(name) for name, value in (flags or {}).items()],
    )


def leading_echo_ids(rows: DataFrame, buffer: int = 20) -> DataFrame:
    """Identities of the assistant rows of ``echo_rows`` that echo one of the last user texts.

    Each assistant row looks its shortened texts up as the last user row with that text:
    one ordered scan per (conversation, text) instead of comparing pairs.
    """
    users = F.when(F.col("role") == "user", 1).otherwise(0)
    ranked = Timeline(rows.select(*ID, "ts", "role", "digest", "probes"), ["convo_id"], CONVO_ORDER)
    ranked = ranked.scan(total={"users": users}).result()
    said = F.col("role") == "user"
    texts = F.when(said, F.array("digest")).otherwise(F.col("probes"))
    both = ranked.select(*ID, "ts", "users", said.alias("said"), F.explode(texts).alias("text_key"))
    asked = Timeline(both, ["convo_id", "text_key"], [*CONVO_ORDER, "said"]).scan(
        prev={"match": F.when(F.col("said"), F.col("users"))}
    )
    hit = F.coalesce(F.col("users") - F.col("match") < buffer, F.lit(False))
    return asked.where(~F.col("said")).columns(hit=hit).where(F.col("hit")).result(*ID).distinct()


def leading_char_echo(messages: DataFrame, buffer: int = 20) -> DataFrame:
    """Assistant rows with ``echo``: a user text of the last ``buffer`` behind 0..k characters."""
    rows = echo_rows(messages)
    hits = leading_echo_ids(rows, buffer).withColumn("echo", F.lit(True))
    assistants = rows.where(F.col("role") == "assistant").select(*ID, "ts", "platform", "digest")
    return assistants.join(hits, ID, "left").fillna(False, ["echo"])


def near_first_sight(rows: DataFrame, seconds: int = 30) -> Timeline:
    """``rows`` with ``passes``: close enough to the first sight of their text that was no ``echo``.

    The seen texts are looked at first: a repeat of a text already let through is judged by its age alone, and only
    a text not seen yet is tested for an echo.  An echo is not remembered.
    """
    log = Timeline(rows, ["convo_id", "digest"], CONVO_ORDER)
    log = log.scan(total={"fresh": F.when(F.col("echo"), 0).otherwise(1)})
    log = log.scan(upto={"first_ts": F.when(~F.col("echo") & (F.col("fresh") == 1), F.col("ts"))})
    return log.columns(passes=F.coalesce(seconds_since("first_ts") < seconds, F.lit(False)))


def first_sight_filter(messages: DataFrame, seconds: int = 30) -> DataFrame:
    """Assistant rows with ``passes``: repeats close to the first sight, and texts not seen yet unless they echo a user."""
    rows = leading_char_echo(messages)
    return near_first_sight(rows, seconds).result(*ID, "ts", "platform", "passes")


def echo_filter_lab(messages: DataFrame) -> DataFrame:
    """``user_input_echo`` for assistant rows equal to a user row under 10 s ago, ten rows back."""
    rows = messages.select(*ID, "ts", "role", tx.digest(tx.strip(F.col("content"))).alias("digest"))
    entry = F.struct("ts", "role", "digest")
    log = Timeline(rows, ["convo_id"], CONVO_ORDER).scan(tail={"recent": (entry, 10)})
    hit = F.exists("recent", lambda e: (e["role"] == "user") & (e["digest"] == F.col("digest")) & (seconds_since(e["ts"]) < 10))
    echo = (F.col("role") == "assistant") & hit
    return log.columns(reason=F.when(echo, "user_input_echo")).result(*ID, "ts", "role", "reason")


def is_new_direct(messages: DataFrame) -> DataFrame:
    """``is_new``: repeats under 30 s pass, over 60 s do not, assistants need a user within 120 s.

    One ordered state per conversation, as users and assistants share the memory of texts: when each text was last let
    through, and when a user row was.  Beyond a hundred texts, those older than ten minutes are forgotten.
    """
    rows = narrow(messages).withColumn("at", F.unix_micros("ts"))
    second = 1_000_000

    def step(state: dict, row: dict) -> dict:
        seen, at = state.setdefault("seen", {}), row["at"]
        gap = at - seen[row["digest"]] if row["digest"] in seen else None
        if gap is not None and gap < 30 * second:
            new = True
        elif gap is not None and gap > 60 * second:
            new = False
        else:
            new = row["role"] != "assistant" or "user" not in state or at - state["user"] <= 120 * second
        if new:
            seen[row["digest"]] = at
            if len(seen) > 100:
                state["seen"] = {k: t for k, t in seen.items() if t >= at - 600 * second}
            if row["role"] == "user":
                state["user"] = at
        return {"is_new": new}

    decided = relay(rows, ["convo_id"], CONVO_ORDER, step, {"is_new": "boolean"})
    return decided.select(*ID, "ts", "role", "is_new")


def is_new_production(messages: DataFrame) -> DataFrame:
    """``is_new``: a text is let through until it has been silent for more than five minutes."""
    log = Timeline(narrow(messages), ["convo_id", "digest"], CONVO_ORDER).scan(prev={"p": F.col("ts")})
    log = log.columns(late=F.when(seconds_since("p") > 300, 1).otherwise(0)).scan(total={"lates": F.col("late")})
    return log.columns(is_new=F.col("lates") == 0).result(*ID, "ts", "role", "is_new")


def repeat_policy(messages: DataFrame) -> DataFrame:
    """``should_log``, ``reason`` and ``repeat_count`` of each row given the first sight of its text."""
    norm = tx.norm_text(F.col("content"))
    rows = messages.select(
        *ID, "ts", "role", tx.digest(norm).alias("digest"), tx.is_musical_command(norm, "repeat").alias("musical")
    )
    log = Timeline(rows, ["convo_id", "digest"], CONVO_ORDER).scan(
        first={"first_ts": F.col("ts"), "first_seq": F.col("seq")}
    )
    repeat = F.col("seq") != F.col("first_seq")
    seen = log.columns(repeat=repeat, age=seconds_since("first_ts")).result()
    active = Timeline(seen, ["convo_id"], CONVO_ORDER).scan(
        upto={"user_ts": F.when(F.col("repeat") & (F.col("role") == "user"), F.col("ts"))}
    )
    idle = seconds_since("user_ts")
    recent = F.coalesce(idle < 120, F.lit(False))
    age = F.col("age")
    reason = (
        F.when(~F.col("repeat"), "first_occurrence")
        .when(F.col("musical") & (age < 60), "legitimate_musical_repeat")
        .when((age < 30) & recent, "conversational_flow")
        .when((age > 300) & ~recent, "historical_retransmission")
        .when((F.col("role") == "assistant") & F.coalesce(idle > 120, F.lit(True)), "orphaned_assistant_response")
        .when((age > 60) & (age < 300), "medium_term_duplicate")
        .otherwise("default_allow")
    )
    blocked = ["historical_retransmission", "orphaned_assistant_response", "medium_term_duplicate"]
    decided = active.columns(reason=reason).columns(should_log=~F.col("reason").isin(blocked)).result()
    counted = Timeline(decided, ["convo_id", "digest"], CONVO_ORDER).scan(
        total={"repeat_count": F.when(F.col("should_log"), 1).otherwise(0)}
    )
    return counted.result(*ID, "ts", "role", "should_log", "reason", "repeat_count")


def user_send_dedup(
    events: DataFrame, session: str = "convo_id", content_grace: int = 10, any_grace: int = 2, reply_after: float = 0.5
) -> DataFrame:
    """User rows with ``accepted``: no equal send processed within 10 s, no send within 2 s of one that awaits its reply.

    An assistant row ``reply_after`` seconds or more after an accepted send ends the waiting, so the next send counts at
    once.  A send that is refused for being early has been processed all the same.
    """
    text = tx.strip(F.col("content"))
    rows = events.where(((F.col("role") == "user") & (text != "")) | (F.col("role") == "assistant"))
    rows = rows.select(session, "seq", "ts", "role", tx.digest(F.col("content")).alias("digest"), F.unix_micros("ts").alias("at"))
    second = 1_000_000

    def step(state: dict, row: dict) -> dict:
        at = row["at"]
        if row["role"] == "assistant":
            if state.get("awaiting") and at - state["sent"] >= reply_after * second:
                state["awaiting"] = False
            return {"accepted": None}
        if row["digest"] == state.get("text") and at - state["processed"] < content_grace * second:
            return {"accepted": False}
        state["text"], state["processed"] = row["digest"], at
        if state.get("awaiting") and at - state["sent"] < any_grace * second:
            return {"accepted": False}
        state["awaiting"], state["sent"] = True, at
        return {"accepted": True}

    decided = relay(rows, [session], CONVO_ORDER, step, {"accepted": "boolean"})
    return decided.where(F.col("role") == "user").select(session, "seq", "ts", "accepted")


def consecutive_window_dedup(messages: DataFrame, seconds: int = 5) -> DataFrame:
    """``kept`` is false if the last logged row has the same text and is under ``seconds`` old."""
    runs = Timeline(narrow(messages), ["convo_id"], CONVO_ORDER).scan(prev={"p": F.col("digest")})
    runs = runs.columns(changed=~F.col("p").eqNullSafe(F.col("digest"))).result().drop("p")
    kept = keep_if_quiet(runs, ["convo_id"], "ts", ["seq"], F.lit(seconds), strict=True, forced=F.col("changed"))
    return kept.drop("changed", "digest")


def genuine_response_fast(messages: DataFrame, earliest: float = 0.5, latest: float = 15.0) -> DataFrame:
    """The first assistant row 0.5 to 15 s after the last user row, with its latency."""
    users = F.when(F.col("role") == "user", 1).otherwise(0)
    rows = messages.select(*ID, "ts", "platform", "role")
    log = Timeline(rows, ["convo_id"], CONVO_ORDER).scan(
        prev={"user": F.when(F.col("role") == "user", F.struct("ts", "seq"))}, total={"exchange": users}
    )
    wait = seconds_since("user.ts")
    answers = log.columns(wait=wait).where((F.col("role") == "assistant") & F.col("wait").between(earliest, latest))
    answers = answers.result()
    firsts = Timeline(answers, ["convo_id", "exchange"], CONVO_ORDER)
    firsts = firsts.scan(prev={"earlier": F.col("seq")}).where(F.col("earlier").isNull())
    latency = (F.unix_millis("ts") - F.unix_millis("user.ts")).alias("latency_ms")
    return firsts.result().select(*ID, "ts", "platform", F.col("user.seq").alias("user_seq"), latency)


def genuine_exchange_step(state: dict, row: dict) -> dict:
    """One event of the user-send / reply tracking; ``event`` is send, user or assistant.

    The state is empty unless a reply is awaited, so it does not outlive its fifteen seconds.
    """
    at, genuine = row["at"], False
    if state and at - state["sent"] > 15_000_000:
        state.clear()
    if row["event"] == "send":
        if not (state and at - state["sent"] < 1_000_000):
            state.update(text=row["digest"], sent=at, seen=False)
    elif row["event"] == "user" and row["marked_at"] is not None and at - row["marked_at"] < 30_000_000:
        state.update(text=row["digest"], sent=at, seen=True)
        genuine = True
    elif state:
        wait = at - state["sent"]
        if row["event"] == "user" and row["digest"] == state["text"] and not state["seen"]:
            state["seen"] = True
            genuine = wait <= 5_000_000
        elif row["event"] == "assistant" and state["seen"] and wait >= 500_000:
            state.clear()
            genuine = True
    return {"genuine": genuine}


def genuine_response_strict(events: DataFrame) -> DataFrame:
    """``genuine`` for every event by the full send / reply state machine of a conversation.

    Columns: convo_id, seq, ts, event (send, user, assistant), content, marked_ts (when an
    input detector marked this user text, or null).
    """
    rows = events.select(
        *ID, "ts", "event", tx.digest(F.col("content")).alias("digest"),
        F.unix_micros("ts").alias("at"), F.unix_micros("marked_ts").alias("marked_at"),
    )
    done = relay(rows, ["convo_id"], CONVO_ORDER, genuine_exchange_step, {"genuine": "boolean"})
    return done.select(*ID, "ts", "event", "genuine")


def debounce_last(updates: DataFrame, key: list[str], quiet_ms: int) -> DataFrame:
    """Bursts of updates to one message as their last text, emitted after a quiet gap."""
    log = Timeline(updates, key, CONVO_ORDER).scan(prev={"p": F.col("ts")})
    late = seconds_since("p") * 1000 > quiet_ms
    log = log.columns(starts=F.when(F.coalesce(late, F.lit(True)), 1).otherwise(0)).scan(total={"burst": F.col("starts")})
    place = F.struct("ts", "seq")
    bursts = log.result().groupBy(*key, "burst").agg(
        F.max_by("content", place).alias("content"),
        F.min_by(tx.digest(F.col("content")), place).alias("first_digest"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("updates"),
    )
    return bursts.withColumns({
        "emit_ts": F.timestamp_micros(F.unix_micros("last_ts") + quiet_ms * 1000),
        "text_changed": F.col("first_digest") != tx.digest(F.col("content")),
    }).drop("first_digest", "last_ts")


def final_shape_filter(bursts: DataFrame, pattern: str = r"^okay\d+\z") -> DataFrame:
    return bursts.where(F.col("content").rlike(pattern))


def persistence_filter(events: DataFrame, key: list[str], threshold_ms: int = 500) -> DataFrame:
    """Added elements that are neither removed nor changed within the threshold.

    ``event`` is add, remove or textChange, ``ts`` and ``seq`` order the events of an element.
    """
    log = Timeline(events, key, CONVO_ORDER).scan(prev={"next_ts": F.col("ts")}, back=True)
    lived = seconds_since("ts", "next_ts") * 1000
    alive = F.col("next_ts").isNull() | (lived >= threshold_ms)
    return log.where((F.col("event") == "add") & alive).result().drop("next_ts")


def ghost_duplicates(rows: DataFrame) -> DataFrame:
    """Rows with ``ghost``: another row of the conversation shows the same text in an established place."""
    keyed = rows.withColumn("digest", tx.digest(tx.norm_text(F.col("content"))))
    established = F.when(F.col("established"), F.lit(True))
    log = Timeline(keyed, ["convo_id", "digest"], CONVO_ORDER).scan(prev={"before": established})
    log = log.scan(prev={"after": established}, back=True)
    ghost = F.col("before").isNotNull() | F.col("after").isNotNull()
    return log.columns(ghost=ghost).result().drop("before", "after", "digest")


def input_cleared_sends(snapshots: DataFrame, session: str = "convo_id") -> DataFrame:
    """Messages sent, seen as an input field that held text and is empty now."""
    size = F.length("content")
    edge = F.when((size > 2) | (size == 0), F.struct(size.alias("size"), "content"))
    log = Timeline(snapshots, [session], CONVO_ORDER).scan(prev={"held": edge})
    sent = log.where((size == 0) & (F.col("held.size") > 2))
    return sent.result().withColumn("content", F.col("held.content")).drop("held")


def duplicate_audit(messages: DataFrame) -> DataFrame:
    """Every occurrence of a text that occurs at least twice, numbered, one row each."""
    log = Timeline(narrow(messages), ["digest"], PLATFORM_ORDER).scan(
        total={"occurrence": F.lit(1)}, prev={"before": F.col("ts")}
    )
    log = log.scan(prev={"after": F.col("ts")}, back=True)
    repeated = F.col("before").isNotNull() | F.col("after").isNotNull()
    return log.where(repeated).result(*ID, "ts", "platform", "role", "digest", "occurrence")
