"""DuckDB twins of the registered queries (the correctness oracle).

Each query is written the plain way — full-session LAG, correlated
EXISTS, chained FULL OUTER joins — so it checks the Spark plans, which
are shaped for scale, against the textbook form. Integer micro-units and
exact half-away-from-zero rounding are used on both sides so that values
agree to the last bit.
"""

from __future__ import annotations

from costlens.functions import rules

TEST_SALT = "fixture-salt"
HOUR_US = 3_600_000_000

# ---- fixed values shared with the registry ---------------------------------
EVENTS_SPLIT = "2024-01-16 00:00:00"
LINEITEM_SPLIT = "1998-06-01 00:00:00"
ORDERS_SPLIT = "1998-01-01 00:00:00"
RANGE_FROM, RANGE_TO = "2024-01-01 00:00:00", "2024-12-31 23:59:59"
BIG_RANGE_FROM, BIG_RANGE_TO = "1995-01-01 00:00:00", "2002-12-31 23:59:59"
ACTIVE_STATUSES = ["PROMO"]


def rr(num: str, den: int, scale: int) -> str:
    """Exact round(num/den, scale), half away from zero, as DOUBLE."""
    f = 10**scale
    n = f"cast({num} as hugeint)"
    return (f"(cast(sign({n}) * ((abs({n}) * {2 * f} + {den}) // {2 * den}) as double) / cast({f} as double))")


def rr_frac(num: str, den: str, scale: int) -> str:
    """Exact round(num/den, scale) for integral expressions, as DOUBLE."""
    f = 10**scale
    n, d = f"cast({num} as hugeint)", f"cast({den} as hugeint)"
    return (f"(cast(sign({n}) * ((abs({n}) * {2 * f} + {d}) // (2 * {d})) as double) / cast({f} as double))")


def pseudonym(raw: str, salt: str = TEST_SALT) -> str:
    return (f"(case when {raw} is null or {raw} = '' or {raw} = 'UNATTRIBUTED' then 'UNATTRIBUTED' "
            f"else substr(sha256('{salt}:' || {raw}), 1, 16) end)")


USER_KEYS = """'s' || cast(user_id as varchar) as session_id,
  case when user_id % 7 = 0 then 'UNATTRIBUTED' else 'PROJ-' || cast(user_id % 97 as varchar) end as issue_key,
  'd' || cast(user_id % 12 as varchar) as developer_id"""

ADAPTERS = {
    "raw_events": f"""select event_id, {USER_KEYS},
  case event_type when 'click' then 'user_prompt' when 'view' then 'stop' when 'purchase' then 'api_request'
    when 'error' then 'tool_result' else 'tool_decision' end as event_name,
  ts, cast(value as decimal(12,6)) as cost_usd,
  case when event_type = 'error' then case event_id % 3 when 0 then 'Bash' when 1 then 'Edit' else 'Write' end end as tool_name,
  case when event_type = 'error' and event_id % 3 = 0 then case event_id % 4 when 0 then 'pytest -q'
    when 1 then 'git commit -m x' when 2 then 'NPM TEST' else 'ls' end end as full_command,
  (event_id % 2 = 0) as success
from events""",
    "spans": """select 'sp' || cast(event_id as varchar) as span_id, case when user_id % 5 <> 0 then 's' || cast(user_id as varchar) end as session_id,
  case when user_id % 7 = 0 then 'UNATTRIBUTED' else 'PROJ-' || cast(user_id % 97 as varchar) end as issue_key,
  'd' || cast(user_id % 12 as varchar) as developer_id,
  't' || cast(user_id as varchar) || '-' || cast(event_id % 3 as varchar) as trace_id,
  case event_type when 'error' then 'tool' when 'purchase' then 'llm_request' when 'signup' then 'other' else 'interaction' end as span_kind,
  ts as start_ts, make_timestamp(epoch_us(ts) + cast(round(value * 1000) as bigint) * 1000) as end_ts
from events""",
    "spans_big": """select 'sp' || cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as span_id,
  'o' || cast(l_orderkey as varchar) as session_id, 'PROJ-' || cast(l_suppkey % 20 as varchar) as issue_key,
  'd' || cast(l_partkey % 12 as varchar) as developer_id, 't' || cast(l_suppkey % 3 as varchar) as trace_id,
  case l_linenumber % 3 when 0 then 'tool' when 1 then 'llm_request' else 'interaction' end as span_kind,
  make_timestamp(epoch_us(l_shipdate) + l_linenumber * cast(60000000 as bigint)) as start_ts,
  make_timestamp(epoch_us(l_shipdate) + l_linenumber * cast(60000000 as bigint) + cast(l_quantity as bigint) * 1000000) as end_ts
from lineitem""",
    "issues": """select 'PROJ-' || cast(p_partkey * 2 as varchar) as issue_key, p_name as summary, p_type as status,
  cast(p_size as decimal(38,6)) as story_points, p_brand as issue_type,
  case when p_size >= 49 then 'u' || cast(p_partkey % 12 as varchar) || '@x.io' end as assignee_email
from part""",
    "prompts": """select 's' || cast(conv_id as varchar) as session_id,
  make_timestamp(1704067200000000 + conv_id * 3600000000 + turn * 60000000) as ts,
  (case (conv_id + turn) % 5 when 0 then 'fix ' when 1 then 'add ' when 2 then 'refactor ' when 3 then 'test ' else '' end) || text as prompt
from conversations where role = 'user'""",
    "commit_log": """select 'c' || cast(o_orderkey as varchar) as commit_sha, 'u' || cast(o_custkey % 12 as varchar) || '@x.io' as author_email,
  o_orderdate as committed_at,
  case when o_orderkey % 9 = 0 then 'plain subject' else 'subject' || chr(10) || chr(10) || 'Session-Id: s' ||
    cast(o_custkey % 150 as varchar) || case when o_orderkey % 4 = 0 then '' else chr(10) || 'Jira-Issue: PROJ-' || cast(o_custkey % 20 as varchar) end end as body,
  ' ' || cast(o_orderkey % 7 + 1 as varchar) || ' files changed, ' || cast(o_orderkey % 50 as varchar) || ' insertions(+)' as shortstat
from orders""",
    "ci_payloads": """select 'c' || cast(o_orderkey as varchar) as commit_sha,
  case when o_orderkey % 3 = 0 then null else 'unit-tests' end as check_name,
  case when o_orderkey % 17 = 0 then 'passed' when o_orderstatus = 'F' then 'SUCCESS' when o_orderstatus = 'O' then 'failure' else 'pending' end as status
from orders""",
    "guardrail_blocks": """select 'b' || cast(event_id as varchar) as block_id, 's' || cast(user_id as varchar) as session_id,
  case when user_id % 7 = 0 then 'UNATTRIBUTED' else 'PROJ-' || cast(user_id % 97 as varchar) end as issue_key,
  case when event_id % 2 = 0 then 'budget_exceeded' else 'thrash_detected' end as reason, ts as blocked_at
from events where event_type = 'error'""",
    "rate_config": "select 'default' as team, cast(75.00 as decimal(10,2)) as hourly_rate_usd",
}


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def ms(ts: str) -> str:
    """Truncate a timestamp to milliseconds (the precision of landed times)."""
    return f"make_timestamp((epoch_us({ts}) // 1000) * 1000)"


def day(ts: str) -> str:
    return f"cast(date_trunc('day', {ts}) as timestamp)"


def classify(col: str, patterns: list[tuple[str, str]], fallback: str) -> str:
    whens = " ".join(f"when regexp_matches({col}, {q(p)}) then {q(n)}" for n, p in patterns)
    return f"case {whens} else {q(fallback)} end"


def extract(col: str, pattern: str) -> str:
    return f"nullif(regexp_extract(coalesce({col}, ''), {q(pattern)}, 1), '')"


def count_part(col: str, pattern: str) -> str:
    return f"coalesce(try_cast({extract(col, pattern)} as integer), 0)"


def utf16_len(col: str) -> str:
    return f"cast(length({col}) + length(regexp_replace({col}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) as integer)"


def rollup_ctes(sfx: str, spans: str, events: str) -> dict[str, tuple[str, list[str]]]:
    """The textbook session rollup (full-session LAG, chained FULL OUTER joins)."""
    return {
        f"wait_time{sfx}": (f"""select session_id, max(issue_key) as issue_key, max(developer_id) as developer_id,
  sum(epoch_us(end_ts) - epoch_us(start_ts)) as wait_us, min(start_ts) as session_start, max(end_ts) as session_end
from {spans} where span_kind in ('tool', 'llm_request') and session_id is not null group by session_id""", [spans]),
        f"turn_boundaries{sfx}": (f"""select session_id, issue_key, developer_id, event_name, ts,
  lag(ts) over w as prev_ts, lag(event_name) over w as prev_event
from {events} where event_name in ('stop', 'user_prompt') and session_id is not null
window w as (partition by session_id order by ts, event_name, issue_key, developer_id)""", [events]),
        f"active_time{sfx}": (f"""select session_id, max(issue_key) as issue_key, max(developer_id) as developer_id,
  sum(least(epoch_us(ts) - epoch_us(prev_ts), 900000000)) as active_us
from turn_boundaries{sfx} where event_name = 'user_prompt' and prev_event = 'stop' and ts > prev_ts
group by session_id""", [f"turn_boundaries{sfx}"]),
        f"token_cost{sfx}": (f"""select session_id, sum(cost_usd) as cost from {events}
where event_name = 'api_request' and session_id is not null group by session_id""", [events]),
        f"session_rollups{sfx}": (f"""select coalesce(w.session_id, a.session_id, t.session_id) as session_id,
  coalesce(w.issue_key, a.issue_key, 'UNATTRIBUTED') as issue_key,
  coalesce(w.developer_id, a.developer_id, 'UNATTRIBUTED') as developer_id,
  coalesce(a.active_us, 0) as active_us, coalesce(w.wait_us, 0) as wait_us,
  coalesce(t.cost, 0) as token_cost_usd, w.session_start, w.session_end
from wait_time{sfx} w
full outer join active_time{sfx} a on a.session_id = w.session_id
full outer join token_cost{sfx} t on t.session_id = coalesce(w.session_id, a.session_id)""",
                                  [f"wait_time{sfx}", f"active_time{sfx}", f"token_cost{sfx}"]),
    }


def _commit_subject(body: str) -> str:
    return f"replace(split_part(coalesce({body}, ''), chr(10) || chr(10), 1), chr(10), ' ')"


SESSION_TRAILER = extract("body", rules.SESSION_TRAILER_PATTERN)

DERIVED: dict[str, tuple[str, list[str]]] = {
    **rollup_ctes("", "spans", "raw_events"),
    **rollup_ctes("_b1", "spans_b1", "raw_events_b1"),
    "spans_b1": (f"select * from spans where start_ts < timestamp {q(EVENTS_SPLIT)}", ["spans"]),
    "raw_events_b1": (f"select * from raw_events where ts < timestamp {q(EVENTS_SPLIT)}", ["raw_events"]),
    "ticket_rollup": (f"""select sr.issue_key, ji.summary, ji.status, cast(ji.story_points as double) as story_points,
  ji.issue_type, count(distinct sr.session_id) as session_count, count(distinct sr.developer_id) as developer_count,
  array_to_string(list_sort(list(distinct sr.developer_id)), ',') as developers,
  {rr('sum(sr.active_us)', HOUR_US, 3)} as active_time_hours,
  {rr('sum(sr.wait_us)', HOUR_US, 3)} as wait_time_hours,
  {rr('sum(sr.token_cost_usd) * 1000000', 1_000_000, 4)} as token_cost_usd,
  cast(rc.hourly_rate_usd as double) as hourly_rate_usd,
  {rr('sum(sr.active_us) * cast(rc.hourly_rate_usd * 100 as hugeint) + sum(sr.token_cost_usd) * 1000000 * 360000', HOUR_US * 100, 2)} as c_total_usd,
  cast(round({rr('sum(sr.active_us) * cast(rc.hourly_rate_usd * 100 as hugeint) + sum(sr.token_cost_usd) * 1000000 * 360000', HOUR_US * 100, 2)} * 100) as hugeint) as c_total_cents,
  cast(round({rr('sum(sr.active_us)', HOUR_US, 3)} * 1000) + round({rr('sum(sr.wait_us)', HOUR_US, 3)} * 1000) as hugeint) as hours_milli,
  min(sr.session_start) as ticket_first_session, max(sr.session_end) as ticket_last_session
from session_rollups sr
left join issues ji on ji.issue_key = sr.issue_key
cross join (select hourly_rate_usd from rate_config where team = 'default') rc
group by sr.issue_key, ji.summary, ji.status, ji.story_points, ji.issue_type, rc.hourly_rate_usd""",
                      ["session_rollups", "issues", "rate_config"]),
    "commit_rows": (f"""select commit_sha, {SESSION_TRAILER} as session_id, {extract('body', rules.ISSUE_TRAILER_PATTERN)} as issue_key,
  {pseudonym('author_email')} as developer_id, {_commit_subject('body')} as subject,
  {count_part('shortstat', rules.SHORTSTAT_FILES_PATTERN)} as files_changed,
  {count_part('shortstat', rules.SHORTSTAT_INSERTIONS_PATTERN)} as insertions,
  {count_part('shortstat', rules.SHORTSTAT_DELETIONS_PATTERN)} as deletions,
  {ms('committed_at')} as committed_at, author_email
from commit_log where {SESSION_TRAILER} is not null""", ["commit_log"]),
    "prompt_rows": (f"""select session_id, cast(null as varchar) as issue_key, 'UNATTRIBUTED' as developer_id,
  {classify('prompt', rules.INTENT_PATTERNS, rules.INTENT_FALLBACK)} as intent,
  regexp_matches(prompt, {q(rules.MENTIONS_TESTS_PATTERN)}) as mentions_tests,
  {utf16_len('prompt')} as prompt_length, {ms('ts')} as ts
from prompts where prompt is not null and length(prompt) > 0""", ["prompts"]),
    "tool_rows": (f"""select session_id, cast(null as varchar) as issue_key, 'UNATTRIBUTED' as developer_id,
  {classify('full_command', rules.COMMAND_PATTERNS, rules.COMMAND_FALLBACK)} as category, {ms('ts')} as ts
from raw_events where event_name = 'tool_result' and tool_name = 'Bash' and full_command is not null
  and length(full_command) > 0""", ["raw_events"]),
    "ci_accepted": (f"""select commit_sha, coalesce(nullif(check_name, ''), {q(rules.CI_DEFAULT_CHECK)}) as check_name,
  lower(status) as status, cast(null as varchar) as url, cast(null as timestamp) as started_at,
  cast(null as timestamp) as completed_at
from ci_payloads where commit_sha is not null and commit_sha <> ''
  and lower(status) in ({', '.join(q(x) for x in rules.CI_STATUSES)})""", ["ci_payloads"]),
    "test_run_events": (f"""select * from raw_events where event_name = 'tool_result' and tool_name = 'Bash'
  and regexp_matches(full_command, {q(rules.TEST_RUN_PATTERN)})""", ["raw_events"]),
    "commit_events": (f"""select * from raw_events where event_name = 'tool_result' and tool_name = 'Bash'
  and regexp_matches(full_command, {q(rules.COMMIT_PATTERN)})""", ["raw_events"]),
    "testing_discipline_daily": (f"""select {day('c.ts')} as day, count(*) as commit_count,
  count(*) filter (where exists (select 1 from test_run_events t
    where t.session_id = c.session_id and t.ts < c.ts and t.success = true)) as commits_with_prior_passing_test
from commit_events c group by 1""", ["test_run_events", "commit_events"]),
    "prompt_thrash": (f"""select session_id, issue_key,
  count(*) filter (where event_name = 'user_prompt') as prompt_count,
  count(*) filter (where event_name = 'tool_result' and tool_name in ('Edit', 'Write')) as mutation_count
from raw_events group by session_id, issue_key""", ["raw_events"]),
    "fanout_big": ("""select session_id, issue_key, count(distinct trace_id) - 1 as subagent_trace_count
from spans_big where session_id is not null group by session_id, issue_key having count(distinct trace_id) > 1""",
                   ["spans_big"]),
    "fanout": ("""select session_id, issue_key, count(distinct trace_id) - 1 as subagent_trace_count
from spans where session_id is not null group by session_id, issue_key having count(distinct trace_id) > 1""", ["spans"]),
    "wait_big": ("""select session_id, min(start_ts) as session_start from spans_big
where span_kind in ('tool', 'llm_request') and session_id is not null group by session_id""", ["spans_big"]),
    "intent_daily": (f"""select {day('ts')} as day, intent, count(*) as prompt_count,
  count(*) filter (where mentions_tests) as mentions_tests_count
from prompt_rows group by 1, 2""", ["prompt_rows"]),
    "pins_b1": ("""select session_id, 'PROJ-' || substr(developer_id, 2) as pin_key from session_rollups_b1
where issue_key = 'UNATTRIBUTED' and cast(substr(session_id, 2) as integer) % 2 = 1""", ["session_rollups_b1"]),
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        deps = DERIVED[n][1] if n in DERIVED else []
        for d in deps:
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


#: Time columns of the adapters that are landed as OTLP, in milliseconds.
LANDED_TIMES = {"raw_events": ["ts"], "spans": ["start_ts", "end_ts"]}


def with_ctes(needs: list[str], body: str, landed: bool = False) -> str:
    """``landed``: over what the landed lines hold, times in milliseconds."""
    ctes = []
    for n in _closure(needs):
        sql = ADAPTERS[n] if n in ADAPTERS else DERIVED[n][0]
        if landed and n in LANDED_TIMES:
            sql = f"select * replace ({', '.join(f'{ms(c)} as {c}' for c in LANDED_TIMES[n])}) from (\n{sql}\n)"
        ctes.append(f"{n} as (\n{sql}\n)")
    if not ctes:
        return body
    return "with " + ",\n".join(ctes) + "\n" + body


def between(col: str, lo: str = RANGE_FROM, hi: str = RANGE_TO) -> str:
    return f"{col} between timestamp {q(lo)} and timestamp {q(hi)}"


ROLLUP_COLS = """session_id, issue_key, developer_id,
  cast(active_us as double) / 1e6 as active_time_sec, cast(wait_us as double) / 1e6 as wait_time_sec,
  cast(token_cost_usd as double) as token_cost_usd, session_start, session_end"""

TICKET_COLS = """issue_key, summary, status, story_points, issue_type, session_count, developer_count, developers,
  active_time_hours, wait_time_hours, token_cost_usd, hourly_rate_usd, c_total_usd, ticket_first_session,
  ticket_last_session"""


def build() -> dict[str, str]:
    Q: dict[str, tuple[list[str], str]] = {
        # sources
        "s1_parse_spans": (["spans"], f"""select span_id, trace_id, session_id, issue_key,
  {pseudonym('developer_id')} as developer_id, 'claude_code.' || span_kind as span_name, span_kind,
  {ms('start_ts')} as start_ts, {ms('end_ts')} as end_ts,
  cast(epoch_us({ms('end_ts')}) // 1000 - epoch_us({ms('start_ts')}) // 1000 as double) as duration_ms,
  cast(0 as double) as cost_usd
from spans"""),
        "s2_parse_events": (["raw_events"], f"""select session_id, issue_key, {pseudonym('developer_id')} as developer_id,
  event_name, {ms('ts')} as ts, tool_name, full_command, success, cast(cost_usd as double) as cost_usd
from raw_events"""),
        "s1_raw_payload": (["spans"], f"""select span_id, cast(null as varchar) as parent_span_id, trace_id, session_id,
  cast(null as varchar) as prompt_id, issue_key, {pseudonym('developer_id')} as developer_id,
  'claude_code.' || span_kind as span_name, span_kind, cast(null as varchar) as tool_name,
  {ms('start_ts')} as start_ts, {ms('end_ts')} as end_ts,
  cast(epoch_us({ms('end_ts')}) // 1000 - epoch_us({ms('start_ts')}) // 1000 as double) as duration_ms,
  cast(0 as double) as cost_usd, cast(0 as bigint) as input_tokens, cast(0 as bigint) as output_tokens,
  '{{"attributes":[{{"key":"session.id","value":' ||
    case when session_id is null then '{{}}' else '{{"stringValue":"' || session_id || '"}}' end ||
    '}}],"endTimeUnixNano":"' || cast(epoch_us(end_ts) * 1000 as varchar) || '","name":"claude_code.' || span_kind ||
    '","spanId":"' || span_id || '","startTimeUnixNano":"' || cast(epoch_us(start_ts) * 1000 as varchar) ||
    '","traceId":"' || trace_id || '"}}' as raw_payload
from spans"""),
        "s2_raw_payload": (["raw_events"], f"""select
  substr(sha256('{{"seq":' || cast(event_id as varchar) || ',"ri":0,"si":0,"pi":0}}'), 1, 32) as event_id,
  session_id, cast(null as varchar) as prompt_id, issue_key, {pseudonym('developer_id')} as developer_id,
  event_name, {ms('ts')} as ts, tool_name, full_command, cast(null as varchar) as decision, success,
  cast(cost_usd as double) as cost_usd, cast(0 as bigint) as input_tokens, cast(0 as bigint) as output_tokens,
  '{{"attributes":[{{"key":"event.name","value":{{"stringValue":"' || event_name || '"}}}}' ||
    coalesce(',{{"key":"tool_name","value":{{"stringValue":"' || tool_name || '"}}}}', '') ||
    coalesce(',{{"key":"tool_parameters","value":{{"stringValue":' ||
      cast(to_json('{{"full_command":"' || full_command || '"}}') as varchar) || '}}}}', '') ||
    ',{{"key":"success","value":{{"boolValue":"' || cast(success as varchar) || '"}}}}' ||
    ',{{"key":"cost_usd","value":{{"doubleValue":"' || cast(cast(cost_usd as double) as varchar) || '"}}}}],' ||
    '"timeUnixNano":"' || cast(epoch_us(ts) * 1000 as varchar) || '"}}' as raw_payload
from raw_events"""),
        "s13_stored_rates": ([], """select n_name as team,
  cast(n_nationkey + 50 + case when n_nationkey % 2 = 1 then 10 else 0 end as double) as hourly_rate_usd from nation
union all select 'default', 75.0"""),
        "s14_stored_guardrails": (["guardrail_blocks"], f"""select block_id, session_id, issue_key, reason, {ms('blocked_at')} as blocked_at
from guardrail_blocks"""),
        "i6_reconcile": (["spans", "raw_events", "commit_rows", "issues"], """select issue_key,
  case when issue_key in (select issue_key from issues) then 'fetched' else 'failed' end as state, true as advanced,
  issue_key in (select issue_key from issues) as known
from (select issue_key from spans union select issue_key from raw_events union select issue_key from commit_rows) s
where issue_key is not null and issue_key <> 'UNATTRIBUTED'
  and issue_key not in (select issue_key from issues where story_points < 25)"""),
        "j13_stored_suggestions": (["session_rollups"], """select 'g-' || session_id as suggestion_id, session_id,
  'PROJ-' || substr(developer_id, 2) as suggested_issue_key,
  case when cast(substr(session_id, 2) as integer) % 2 = 1 then 'confirmed' else 'rejected' end as status,
  'reviewer' as reviewed_by, timestamp '2024-02-01 00:00:00' as reviewed_at, cast(1 as bigint) as decided_seq
from session_rollups where issue_key = 'UNATTRIBUTED'"""),
        "p30_hook_sessions": (["prompts"], """select case when n % 3 = 0 then 'w' || cast(n as varchar) when n % 4 <> 3 then session_id end as session_id,
  count(*) as prompts
from (select *, cast(substr(session_id, 2) as bigint) as n from prompts) p
where prompt is not null and length(prompt) > 0 group by 1"""),
        "s3_commit_records": (["commit_rows"], """select commit_sha, session_id, issue_key, developer_id, subject,
  files_changed, insertions, deletions, committed_at from commit_rows"""),
        "s4_prompt_signals": (["prompt_rows"], "select * from prompt_rows"),
        "s5_tool_signals": (["tool_rows"], "select * from tool_rows"),
        "s6_issue_payloads": (["issues"], """select issue_key, summary, status, cast(story_points as double) as story_points,
  issue_type, assignee_email from issues"""),
        "s7_ci_accepted": (["ci_accepted"], "select * from ci_accepted"),
        "s7_ci_rejected": (["ci_payloads"], f"""select 'ci_runs' as source,
  case when commit_sha is null or commit_sha = '' then 'missing_commit_sha' else 'bad_status' end as reason,
  count(*) as rows
from ci_payloads where commit_sha is null or commit_sha = ''
  or lower(status) not in ({', '.join(q(x) for x in rules.CI_STATUSES)}) or status is null
group by 1, 2"""),
        "s10_quarantine": (["raw_events"], """select * from (
  select 'logs' as source, 'bad_cost' as reason, count(*) as rows from raw_events
  where event_name = 'api_request' and cost_usd > 40
  union all
  select 'logs', 'malformed_line', count(*) from documents where text is not null and not regexp_matches(text, '^\\s*$')
) where rows > 0"""),
        # core
        "c2_session_rollups": (["session_rollups"], f"select {ROLLUP_COLS} from session_rollups"),
        "c3_ticket_rollup": (["ticket_rollup"], f"select {TICKET_COLS} from ticket_rollup"),
        "c4_refresh_rollups": (["session_rollups"], f"select {ROLLUP_COLS} from session_rollups"),
        "c4_refresh_textbook": (["session_rollups"], f"select {ROLLUP_COLS} from session_rollups"),
        "u1_touched_sessions": (["spans", "raw_events"], f"""select distinct session_id from (
  select session_id from spans where start_ts >= timestamp {q(EVENTS_SPLIT)}
  union all select session_id from raw_events where ts >= timestamp {q(EVENTS_SPLIT)}) s where session_id is not null"""),
        "c8_missing_issue_keys": (["spans", "raw_events", "commit_rows", "issues"], """select distinct issue_key from (
  select issue_key from spans union all select issue_key from raw_events union all select issue_key from commit_rows) s
where issue_key is not null and issue_key <> 'UNATTRIBUTED'
  and not exists (select 1 from issues i where i.issue_key = s.issue_key)"""),
        "f8_unattributed_sessions": (["session_rollups"], """select session_id, developer_id,
  cast(token_cost_usd as double) as token_cost_usd from session_rollups where issue_key = 'UNATTRIBUTED'"""),
        "f10_missing_since": (["spans", "raw_events", "commit_rows", "issues"], f"""select distinct issue_key from (
  select issue_key from spans where start_ts >= timestamp {q(EVENTS_SPLIT)}
  union all select issue_key from raw_events where ts >= timestamp {q(EVENTS_SPLIT)}
  union all select issue_key from commit_rows where committed_at >= timestamp {q(ORDERS_SPLIT)}) s
where issue_key is not null and issue_key <> 'UNATTRIBUTED'
  and not exists (select 1 from issues i where i.issue_key = s.issue_key)"""),
        # hygiene
        "a5_testing_discipline": (["testing_discipline_daily"], f"""select day, commit_count, commits_with_prior_passing_test,
  {rr_frac('100 * commits_with_prior_passing_test', 'commit_count', 1)} as testing_discipline_pct
from testing_discipline_daily"""),
        "a6_prompt_thrash": (["prompt_thrash"], f"""select session_id, issue_key, prompt_count, mutation_count,
  {rr_frac('prompt_count', 'greatest(mutation_count, 1)', 2)} as thrash_ratio from prompt_thrash"""),
        "a7_subagent_fanout": (["fanout_big"], "select * from fanout_big"),
        "a8_guardrail_blocks_daily": (["guardrail_blocks"], f"""select {day('blocked_at')} as day, reason,
  count(*) as block_count from guardrail_blocks group by 1, 2"""),
        "a9_prompt_intent_daily": (["intent_daily"], f"""select day, intent, prompt_count, mentions_tests_count,
  {rr_frac('100 * mentions_tests_count', 'prompt_count', 1)} as mentions_tests_pct from intent_daily"""),
        "a10_tool_category_daily": (["tool_rows"], f"""select {day('ts')} as day, category, count(*) as tool_call_count
from tool_rows group by 1, 2"""),
        # panels
        "p01_total_spend": (["ticket_rollup"], """select coalesce(cast(sum(c_total_cents) as double) / cast(100 as double), 0)
  as total_spend from ticket_rollup"""),
        "p02_tickets_tracked": (["ticket_rollup"], "select count(*) as tickets from ticket_rollup"),
        "p03_sessions_ingested": (["session_rollups"], "select count(*) as sessions from session_rollups"),
        "p04_commits_correlated": (["commit_rows"], "select count(distinct commit_sha) as commits from commit_rows"),
        "p05_cost_leaderboard": (["ticket_rollup"], """select issue_key, summary, status, session_count,
  active_time_hours, wait_time_hours, c_total_usd
from ticket_rollup order by c_total_cents desc, issue_key limit 50"""),
        "p06_time_split": (["ticket_rollup"], """select case when length(issue_key || ': ' || coalesce(summary, '(no summary)')) > 50
  then left(issue_key || ': ' || coalesce(summary, '(no summary)'), 49) || '…'
  else issue_key || ': ' || coalesce(summary, '(no summary)') end as ticket, active_time_hours, wait_time_hours
from ticket_rollup order by hours_milli desc, issue_key limit 25"""),
        "p07_testing_discipline": (["testing_discipline_daily"], f"""select day as time,
  {rr_frac('100 * commits_with_prior_passing_test', 'commit_count', 1)} as testing_discipline_pct
from testing_discipline_daily where {between('day')}"""),
        "p08_prompt_thrash": (["prompt_thrash", "session_rollups"], f"""select {day('sr.session_start')} as time,
  (cast(sum(cast(round({rr_frac('pt.prompt_count', 'greatest(pt.mutation_count, 1)', 2)} * 100) as hugeint)) as double)
    / cast(100 as double))
    / cast(count(*) as double) as avg_thrash_ratio
from prompt_thrash pt join session_rollups sr on sr.session_id = pt.session_id
where {between('sr.session_start')} group by 1"""),
        "p10_subagent_fanout": (["fanout_big", "wait_big"], f"""select {day('w.session_start')} as time,
  count(*) as sessions_with_subagent_fanout
from fanout_big f join wait_big w on w.session_id = f.session_id
where {between('w.session_start', BIG_RANGE_FROM, BIG_RANGE_TO)} group by 1"""),
        "p11_guardrail_blocks": (["guardrail_blocks"], f"""select {day('blocked_at')} as time, reason, count(*) as block_count
from guardrail_blocks group by 1, 2 having {between(day('blocked_at'))}"""),
        "p13_prompt_intent": (["intent_daily"], f"select day as time, intent, prompt_count from intent_daily where {between('day')}"),
        "p14_tool_category": (["tool_rows"], f"""select {day('ts')} as time, category, count(*) as tool_call_count
from tool_rows group by 1, 2 having {between(day('ts'))}"""),
        "p15_mentions_tests": (["intent_daily"], f"""select case when sum(prompt_count) = 0 then null else
  {rr_frac('100 * sum(mentions_tests_count)', 'sum(prompt_count)', 1)} end as mentions_tests_pct
from intent_daily where {between('day')}"""),
        # merges
        "k1_spans_insert_ignore": (["spans_big"], f"""select span_id, session_id, issue_key, developer_id, trace_id, span_kind,
  start_ts, end_ts from (
  select *, row_number() over (partition by span_id order by
    case when start_ts < timestamp {q(LINEITEM_SPLIT)} then 0 else 1 end,
    session_id, issue_key, developer_id, trace_id, span_kind, start_ts, end_ts) as rn
  from spans_big) where rn = 1"""),
        "k2_events_insert_ignore": (["raw_events"], """select session_id, issue_key, developer_id, event_name, ts, tool_name,
  full_command, success, cast(cost_usd as double) as cost_usd from raw_events
union all
select cast(null as varchar), issue_key, developer_id, event_name, ts, tool_name, full_command, success,
  cast(cost_usd as double) from raw_events where event_name = 'api_request'"""),
        "k3_commit_upsert": (["commit_rows"], f"""select commit_sha, session_id, issue_key, developer_id,
  case when insertions >= 25 then 'amended' else subject end as subject, files_changed, insertions, deletions,
  committed_at, cast(case when committed_at < timestamp {q(ORDERS_SPLIT)} then 1 else 2 end as bigint) as ingested_batch
from commit_rows"""),
        "k4_register_developers": (["raw_events", "commit_rows"], f"""select distinct {pseudonym('developer_id')} as developer_id,
  cast(null as varchar) as git_email, developer_id as display_name from raw_events
  where developer_id is not null and developer_id <> 'UNATTRIBUTED'
union
select distinct {pseudonym('author_email')}, author_email, cast(null as varchar) from commit_rows"""),
        "k7_issue_upsert": ([], """select 'PROJ-' || cast(p_partkey * 2 as varchar) as issue_key, p_name as summary,
  case when p_size >= 45 then 'Done' else p_type end as status, cast(p_size as double) as story_points,
  p_brand as issue_type, case when p_size >= 49 then 'u' || cast(p_partkey % 12 as varchar) || '@x.io' end as assignee_email,
  cast(case when p_size >= 45 then 2 else 1 end as bigint) as updated_batch
from part"""),
        "k8_ci_upsert": (["ci_accepted"], """select commit_sha, check_name,
  case when status = 'pending' then 'success' else status end as status, url, started_at, completed_at,
  cast(case when status = 'pending' then 2 else 1 end as bigint) as ingested_batch
from ci_accepted"""),
        "c9_apply_reviews": (["session_rollups"], """select session_id,
  case when issue_key = 'UNATTRIBUTED' and cast(substr(session_id, 2) as integer) % 2 = 1
    then 'PROJ-' || substr(developer_id, 2) else issue_key end as issue_key, developer_id,
  case when issue_key = 'UNATTRIBUTED' and cast(substr(session_id, 2) as integer) % 2 = 1
    then 'ai_confirmed' else 'explicit' end as attribution_source
from session_rollups"""),
        "k9_pinned_upsert": (["session_rollups", "pins_b1"], """select f.session_id,
  coalesce(p.pin_key, f.issue_key) as issue_key, f.developer_id,
  cast(f.active_us as double) / 1e6 as active_time_sec, cast(f.wait_us as double) / 1e6 as wait_time_sec,
  cast(f.token_cost_usd as double) as token_cost_usd, f.session_start, f.session_end,
  case when p.pin_key is not null then 'ai_confirmed' else 'explicit' end as attribution_source
from session_rollups f left join pins_b1 p on p.session_id = f.session_id"""),
        # context
        "j9_commits_by_ticket": (["commit_rows", "session_rollups"], """select sr.issue_key, count(*) as commit_count,
  cast(sum(c.files_changed) as bigint) as files_changed, cast(sum(c.insertions) as bigint) as insertions,
  cast(sum(c.deletions) as bigint) as deletions
from commit_rows c join session_rollups sr on sr.session_id = c.session_id group by sr.issue_key"""),
        "j10_ci_by_ticket": (["ci_accepted", "commit_rows", "session_rollups"], """select sr.issue_key, ci.status,
  count(*) as run_count
from ci_accepted ci join commit_rows c on c.commit_sha = ci.commit_sha
join session_rollups sr on sr.session_id = c.session_id group by sr.issue_key, ci.status"""),
        "j11_session_signal_mix": (["session_rollups", "prompt_rows", "tool_rows"], """select sr.session_id, sr.issue_key,
  cast(coalesce(p.n, 0) as bigint) as prompt_signals, cast(coalesce(p.t, 0) as bigint) as test_prompts,
  cast(coalesce(t.n, 0) as bigint) as tool_calls, cast(coalesce(t.t, 0) as bigint) as test_runs
from session_rollups sr
left join (select session_id, count(*) as n, count(*) filter (where mentions_tests) as t from prompt_rows
  where session_id is not null group by 1) p on p.session_id = sr.session_id
left join (select session_id, count(*) as n, count(*) filter (where category = 'test') as t from tool_rows
  where session_id is not null group by 1) t on t.session_id = sr.session_id"""),
        "j12_single_candidate": (["session_rollups", "issues", "raw_events"], f"""select s.session_id, s.developer_id,
  o.only_key as suggested_issue_key
from session_rollups s
join (select distinct developer_id, 'u' || substr(developer_id, 2) || '@x.io' as assignee_email from raw_events) ids
  on ids.developer_id = s.developer_id
join (select assignee_email, min(issue_key) as only_key from issues
  where status in ({', '.join(q(x) for x in ACTIVE_STATUSES)}) and assignee_email is not null
  group by assignee_email having count(*) = 1) o on o.assignee_email = ids.assignee_email
where s.issue_key = 'UNATTRIBUTED'"""),
        "p20_resolve_issue_key": ([], f"""select launch_id,
  coalesce(nullif(issue_flag, ''), {extract('branch', rules.ISSUE_KEY_PATTERN)}, 'UNATTRIBUTED') as issue_key,
  case when nullif(issue_flag, '') is not null then 'flag'
    when {extract('branch', rules.ISSUE_KEY_PATTERN)} is not null then 'git-branch' else 'fallback' end as issue_key_source
from (select p_partkey as launch_id,
    case when p_size % 4 = 0 then 'OPS-' || cast(p_partkey as varchar) end as issue_flag,
    lower(p_type) || '/' || case when p_size % 3 = 0 then lower(replace(p_brand, 'Brand#', 'BR-'))
      else replace(p_brand, 'Brand#', 'BR-') end || '-' || replace(p_name, ' ', '-') as branch
  from part) l"""),
        "p21_resolve_developer": ([], f"""select identity_id,
  coalesce(nullif(git_email, ''), nullif(git_name, ''), 'UNATTRIBUTED') as raw_developer_id,
  nullif(git_email, '') is not null as is_email,
  case when nullif(git_email, '') is not null then 'git-email' when nullif(git_name, '') is not null then 'git-name'
    else 'fallback' end as developer_source,
  {pseudonym("coalesce(nullif(git_email, ''), nullif(git_name, ''), 'UNATTRIBUTED')")} as developer_id
from (select c_custkey as identity_id,
    case when c_custkey % 3 <> 0 then 'u' || cast(c_custkey % 12 as varchar) || '@x.io' end as git_email,
    case when c_custkey % 5 <> 0 then c_name else '' end as git_name
  from customer) g"""),
        "c11_pseudonymise": (["commit_log"], f"select commit_sha, {pseudonym('author_email')} as developer_id from commit_log"),
    }
    # the same content through stored tables
    for stored, plain in (("i9_cross_batch_spans", "k1_spans_insert_ignore"), ("k3_stored_commits", "k3_commit_upsert"),
                          ("k7_stored_issues", "k7_issue_upsert"), ("k8_stored_ci", "k8_ci_upsert"),
                          ("k5_stored_prompt_signals", "s4_prompt_signals"), ("k6_stored_tool_signals", "s5_tool_signals"),
                          ("j13_stored_rollups", "c9_apply_reviews"), ("s12_landed_lines", "s2_parse_events")):
        Q[stored] = Q[plain]
    found = {name: with_ctes(needs, body) for name, (needs, body) in Q.items()}
    found["s15_store_panels"] = with_ctes(*store_panels(Q), landed=True)
    return found


#: Panel → time, label and up to four values of its frame.
PANEL_SHAPES = {
    "p01_total_spend": (None, None, "total_spend"), "p02_tickets_tracked": (None, None, "tickets"),
    "p03_sessions_ingested": (None, None, "sessions"), "p04_commits_correlated": (None, None, "commits"),
    "p05_cost_leaderboard": (None, "concat_ws('|', issue_key, summary, status)", "session_count", "active_time_hours",
                             "wait_time_hours", "c_total_usd"),
    "p06_time_split": (None, "ticket", "active_time_hours", "wait_time_hours"),
    "p07_testing_discipline": ("time", None, "testing_discipline_pct"),
    "p08_prompt_thrash": ("time", None, "avg_thrash_ratio"),
    "p10_subagent_fanout": ("time", None, "sessions_with_subagent_fanout"),
    "p11_guardrail_blocks": ("time", "reason", "block_count"),
    "p13_prompt_intent": ("time", "intent", "prompt_count"),
    "p14_tool_category": ("time", "category", "tool_call_count"),
    "p15_mentions_tests": (None, None, "mentions_tests_pct"),
}


def store_panels(queries: dict[str, tuple[list[str], str]]) -> tuple[list[str], str]:
    """All panels under one another, over what the landed lines hold."""
    needs, parts = [], []
    for name, (time, label, *values) in PANEL_SHAPES.items():
        wanted, body = queries[name]
        if name == "p10_subagent_fanout":  # of the landed spans
            wanted = ["fanout", "session_rollups"]
            body = f"""select {day('w.session_start')} as time, count(*) as sessions_with_subagent_fanout
from fanout f join session_rollups w on w.session_id = f.session_id where {between('w.session_start')} group by 1"""
        needs += wanted
        cells = [f"cast({v} as double) as v{i}" for i, v in enumerate([*values, *["null"] * (4 - len(values))])]
        parts.append(f"select '{name[:3]}' as panel, cast({time or 'null'} as timestamp) as time, cast({label or 'null'} as varchar) as label, "
                     f"{', '.join(cells)} from ({body}) x")
    return list(dict.fromkeys(needs)), "\nunion all\n".join(parts)
