"""DuckDB SQL for the corpus queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {}

SQL["op8_substring_dedup"] = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT r, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35),
h AS (SELECT s.r, s.i, md5(array_to_string(list_slice(w.ws, s.i, s.i + 34), ' ')) AS x FROM s JOIN w USING (r)),
d AS (SELECT r, i FROM h WHERE x IN (SELECT x FROM h GROUP BY x HAVING count(*) > 1)),
c AS (SELECT DISTINCT r, i + j AS p FROM d, (SELECT unnest(generate_series(0, 34)) AS j)),
k AS (SELECT w.r, u.p, u.word FROM w, unnest(ws) WITH ORDINALITY AS u(word, p) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.r = w.r AND c.p = u.p)),
t AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM k GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(t.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t.text, '')) AS kept_sha256
FROM w LEFT JOIN t USING (r)
"""

SQL["op10_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS least, n >= 100 AND page_id <> min(page_id) OVER (PARTITION BY digest) AS again FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN least END AS refers_to FROM f
"""


def _clusters(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Assignments and means, one pair of steps for each round."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x FROM v WHERE vec_id IS NOT NULL ORDER BY c LIMIT {k})",
    ]
    assign = lambda j: f"a{j} AS MATERIALIZED (SELECT r, vec_id, vx, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, v.vec_id, v.x AS vx, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c{j} AS c) GROUP BY r, vec_id, vx)"
    for j in range(rounds):
        steps.append(assign(j))
        steps.append(f"m{j} AS (SELECT c, list(y ORDER BY i) AS x FROM (SELECT c, i, CAST(floor(sum(vx[i]) / count(*)) AS BIGINT) AS y FROM a{j}, range(1, {dims + 1}) AS t(i) GROUP BY c, i) GROUP BY c)")
        steps.append(f"c{j + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{j} AS c LEFT JOIN m{j} AS m USING (c))")
    steps.append(assign(rounds))
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c USING (c)
"""


SQL["op11_centroid_clusters"] = _clusters()


def _crc(text: str) -> str:
    """CRC-32 of an ASCII text: each byte is mixed in, then eight shifts (marked by -1) follow."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda x: [ord(x), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(v, x) ELSE xor(v >> 1, 3988292384 * (v & 1)) END"
    return f"xor(list_reduce(list_concat([4294967295], CAST({steps} AS BIGINT[])), lambda v, x: {step}), 4294967295)"


def _repair() -> str:
    """Costs, audits and repaired turns to go from each of four states, row by row from a conversation's end."""
    states = {0: "", 1: "s", 2: "u", 3: "a"}
    due = {0: 2, 1: 2, 2: 3, 3: 2}
    role = {2: "user", 3: "assistant"}
    free = "f NOT IN (1, 2)"
    more = "CASE WHEN f = 3 THEN 5 ELSE 0 END"

    def edits(state: int) -> list[str]:
        """Candidates (cost, audit, turns) from a state over the row (i, t, f, role, text), up to two inserts first."""
        found, prefix, cost, at, turns = [], "", 0, state, []
        for _ in range(3):
            new = lambda more: "[" + ", ".join([*(f"'{x}:'" for x in turns), *more]) + "]"  # noqa: B023, E731
            found.append(f"struct_pack(c := {cost + 2} + s{at}.c, a := '{prefix}D' || s{at}.a, t := {new([])} || s{at}.t)")
            to = due[at]
            rerole = f"struct_pack(c := {cost + 1} + {more} + s{to}.c, a := '{prefix}R' || s{to}.a, t := {new([f"'{role[to]}:' || text"])} || s{to}.t)"
            found.append(f"CASE WHEN {free} THEN {rerole} END")
            for letter, goal in (("s", 1), ("u", 2), ("a", 3)):
                if goal == (1 if letter == "s" and at == 0 else due[at]) and (letter != "s" or at == 0):
                    keep = f"struct_pack(c := {cost} + {more} + s{goal}.c, a := '{prefix}K' || s{goal}.a, t := {new(["role || ':' || text"])} || s{goal}.t)"
                    found.append(f"CASE WHEN {free} AND i = '{letter}' THEN {keep} END")
            turns, prefix, cost, at = [*turns, role[due[at]]], prefix + "I", cost + 5, due[at]
        return found

    best = lambda state: f"list_sort(list_filter([{', '.join(edits(state))}], lambda x: x IS NOT NULL))[1]"
    end = {0: (0, "", []), 1: (10, "II", ["user", "assistant"]), 2: (5, "I", ["assistant"]), 3: (0, "", [])}
    last = lambda state: "struct_pack(c := CAST({} AS BIGINT), a := '{}', t := CAST([{}] AS VARCHAR[]))".format(end[state][0], end[state][1], ", ".join(f"'{x}:'" for x in end[state][2]))
    one = r"[^\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
w AS (SELECT DISTINCT k, {_crc("k")} % 20 AS what FROM h),
d AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h JOIN w USING (k), generate_series(1, CASE WHEN what = 3 THEN 2 ELSE 1 END) AS g(x) WHERE what <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n FROM d),
f AS (
  SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS i,
    CASE WHEN NOT regexp_matches(text, '{one}') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS f FROM o),
z AS (SELECT *, lead(i) OVER (PARTITION BY conv_id ORDER BY n) AS following FROM f),
g AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate,
    count(*) FILTER (f = 3) AS truncated, count(*) FILTER (following IS NOT NULL AND i || following NOT IN ('su', 'ua', 'au')) AS illegal FROM z GROUP BY conv_id),
dp AS (
  SELECT conv_id, rows AS n, {", ".join(f"{last(s)} AS s{s}" for s in states)} FROM g UNION ALL
  SELECT dp.conv_id, dp.n - 1, {", ".join(f"{best(s)} AS s{s}" for s in states)} FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.n = dp.n),
r AS (SELECT conv_id, s0.c AS cost, s0.a AS audit, sha256(array_to_string(s0.t, chr(10))) AS digest FROM dp WHERE n = 0),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM every e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id
"""


SQL["op13_conversation_repair"] = _repair()
