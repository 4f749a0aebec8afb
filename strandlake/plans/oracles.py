"""DuckDB SQL for the registered queries, written from the definitions and not from Spark's plans.

Reads are unrolled into rows (read x strand x round, read x strand x site x window) and put together with
windows, where the operators work on columns of one row."""

from __future__ import annotations

from itertools import product

from strandlake.sources.derive import REFERENCE as _REF

_C64 = "".join("".join(c) for c in product("TCAG", repeat=3))
_AA = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def _codon(k: str) -> str:
    return f"substr('{_C64}', (1 + 3 * (({k}) % 64))::INT, 3)"


def _aa(dna: str) -> str:
    place = f"strpos('{'.'.join(_C64[i : i + 3] for i in range(0, 192, 3))}', substr({dna}, i::INT, 3))"
    letter = f"CASE WHEN length(substr({dna}, i::INT, 3)) = 3 AND {place} > 0 THEN substr('{_AA}', (({place} + 3) / 4)::INT, 1) ELSE 'X' END"
    return f"list_aggregate([{letter} FOR i IN range(1, length({dna}) + 1, 3)], 'string_agg', '')"


def _mean_q(q: str) -> str:
    return f"(list_sum([ord(substr({q}, i::INT, 1)) - 33 FOR i IN range(1, length({q}) + 1)])::DOUBLE / length({q}))"


def _no_stop(dna: str) -> str:
    return f"NOT list_bool_or([substr({dna}, i::INT, 3) IN ('TAA', 'TAG', 'TGA') FOR i IN range(1, length({dna}) - 1, 3)])"


def _rc(s: str) -> str:
    return f"reverse(translate({s}, 'ATCG', 'TAGC'))"


_VALID = "(regexp_matches(header, '^@.') AND starts_with(sep, '+') AND regexp_full_match(seq, '[ACGTNacgtn]+') AND regexp_full_match(qual, '[!-~]+') AND length(seq) = length(qual))"

_READS = f"""
ev AS (SELECT event_id AS e, user_id AS u FROM events),
parts AS (
  SELECT e, 'ACGTTGCAAGCTTC' || (CASE e % 3 WHEN 0 THEN 'GCTCAGATCG' WHEN 1 THEN 'GCTCAGATTG' ELSE 'GCTCAGACAG' END) AS pr,
         'ACGTTGCAAGCTTC' || (CASE e % 3 WHEN 0 THEN 'GCTCAGATTG' WHEN 1 THEN 'GCTCAGACAG' ELSE 'GCTCAGATCG' END) AS other,
         CASE WHEN e % 6 = 2 THEN 'GCTTGGAAA' ELSE {_codon('u')} || {_codon('u * 7 + e % 4')} || {_codon('u + e % 3')} END AS cds0
  FROM ev),
sense AS (
  SELECT e, substr((CASE WHEN e % 20 = 7 THEN repeat('AC', 12) WHEN e % 37 = 6 THEN 'GG' || substr(pr, 3) WHEN e % 31 = 5 THEN 'G' || substr(pr, 2)
                    WHEN e % 29 = 4 THEN 'N' || substr(pr, 2) ELSE pr END) || cds0 || (CASE WHEN e % 43 = 9 THEN other ELSE 'CAATCGATCGATCGATCGATGC' END),
                   1, CASE WHEN e % 41 = 8 THEN 30 ELSE 300 END) AS s
  FROM parts),
quals AS (
  SELECT e, s, CASE WHEN e % 25 = 3 THEN repeat('$', length(s)) WHEN e % 17 = 2 THEN substr(repeat('I', 24) || repeat('%', 9) || repeat('I', 300), 1, length(s)) ELSE repeat('I', length(s)) END AS q
  FROM sense),
turned AS (SELECT e, CASE WHEN e % 10 = 0 THEN {_rc('s')} ELSE s END AS s, CASE WHEN e % 10 = 0 THEN reverse(q) ELSE q END AS q FROM quals),
reads AS (
  SELECT (e % 6)::INT AS source_id, e AS ordinal,
         '@r' || (CASE WHEN e % 50 = 0 THEN e + 3 ELSE e END) || (CASE WHEN e % 7 = 0 THEN '' ELSE ' qs:f:' || (e % 30) || '.5' END) AS header,
         CASE WHEN e % 53 = 10 THEN 'X' || substr(s, 2) WHEN e % 23 = 11 THEN lower(s) ELSE s END AS seq, '+' AS sep,
         CASE WHEN e % 59 = 12 THEN substr(q, 2) ELSE q END AS qual
  FROM turned),
judged AS (SELECT *, {_VALID} AS valid FROM reads)"""


def _assign(bound: bool = False, read_q: float = 20.0, adaptive: bool = True) -> str:
    rv = "" if adaptive else " WHEN strpos(substr(so, (fe + 1)::INT), 'CAATCGATCG') > 0 AND fe + 9 > fe + strpos(substr(so, (fe + 1)::INT), 'CAATCGATCG') - 1 THEN 'discard_length_indel'"
    return f"""{_READS},
rq AS (SELECT *, CASE WHEN valid THEN {_mean_q('qual')} END AS read_q FROM judged),
strands AS (SELECT ordinal, source_id, 1 AS strand, upper(seq) AS s, qual AS q FROM rq UNION ALL SELECT ordinal, source_id, -1, {_rc('upper(seq)')}, reverse(qual) FROM rq),
rounds AS (SELECT * FROM (VALUES (0, 'Round_0', 'GCTCAGATCG'), (1, 'Round_1', 'GCTCAGATTG'), (2, 'Round_2', 'GCTCAGACAG')) t(r, name, anchor)),
found AS (SELECT st.ordinal, st.strand, st.s, r.r, strpos(st.s, r.anchor) - 1 AS a FROM strands st, rounds r WHERE contains(st.s, r.anchor) {'AND r.r = st.source_id % 3' if bound else ''}),
scored AS (SELECT *, list_sum([CASE WHEN a - 14 + j < 0 THEN 1.0 WHEN substr(s, (a - 14 + j + 1)::INT, 1) = 'N' THEN 0.5 WHEN substr(s, (a - 14 + j + 1)::INT, 1) <> substr('ACGTTGCAAGCTTC', (j + 1)::INT, 1) THEN 1.0 ELSE 0.0 END FOR j IN range(0, 14)])::DOUBLE AS pen FROM found),
ranked AS (SELECT *, row_number() OVER w AS k, lead(pen) OVER w AS nxt FROM scored WINDOW w AS (PARTITION BY ordinal, strand ORDER BY pen, r)),
verdict AS (SELECT st.ordinal, st.strand, b.r, b.pen, b.a + 10 AS fe, CASE WHEN b.r IS NULL THEN 'no_anchor' WHEN b.pen > 1 THEN 'barcode_mismatch' WHEN b.nxt - b.pen < 1 THEN 'ambiguous' ELSE 'assigned' END AS v FROM strands st LEFT JOIN (SELECT * FROM ranked WHERE k = 1) b USING (ordinal, strand)),
pair AS (SELECT q.*, f.v AS fv, b.v AS bv, list_position(['no_anchor', 'barcode_mismatch', 'ambiguous', 'assigned'], f.v) AS fr, list_position(['no_anchor', 'barcode_mismatch', 'ambiguous', 'assigned'], b.v) AS br FROM rq q JOIN verdict f ON q.ordinal = f.ordinal AND f.strand = 1 JOIN verdict b ON q.ordinal = b.ordinal AND b.strand = -1),
stated AS (SELECT *, CASE WHEN NOT valid THEN 'malformed_fastq' WHEN read_q < {read_q} THEN 'low_quality' WHEN br > fr THEN bv ELSE fv END AS status FROM pair),
oriented AS (SELECT *, CASE WHEN status = 'assigned' THEN CASE WHEN fv = 'assigned' THEN 1 ELSE -1 END END AS st FROM stated),
placed AS (SELECT o.ordinal, o.status, o.st AS strand, v.r, v.pen, v.fe, s.s AS so, s.q AS qo FROM oriented o LEFT JOIN verdict v ON v.ordinal = o.ordinal AND v.strand = o.st LEFT JOIN strands s ON s.ordinal = o.ordinal AND s.strand = o.st),
cut AS (SELECT *, CASE WHEN fe + 9 <= length(so) THEN substr(so, (fe + 1)::INT, 9) END AS cds, CASE WHEN fe + 9 <= length(so) THEN {_mean_q('substr(qo, (fe + 1)::INT, 9)')} END AS cds_q FROM placed),
done AS (SELECT c.*, r.name AS round, CASE WHEN status <> 'assigned' THEN status WHEN cds IS NULL THEN 'discard_truncated'{rv} WHEN cds_q < 20 THEN 'discard_low_quality_cds' WHEN NOT ({_no_stop('cds')}) THEN 'discard_stop_codon' ELSE 'passed_qc' END AS bucket FROM cut c LEFT JOIN rounds r ON c.r = r.r)"""


_DONE = _assign()
_COUNTS = f"{_DONE}, counts AS (SELECT round, cds AS dna, count(*) AS n FROM done WHERE bucket = 'passed_qc' GROUP BY ALL)"
_AAC = f"{_COUNTS}, aac AS (SELECT round, {_aa('dna')} AS aa, sum(n)::BIGINT AS n FROM counts GROUP BY ALL)"
_FUNNEL = """SELECT round, count(*) AS total_assigned, count(*) FILTER (bucket = 'discard_truncated') AS discard_truncated, count(*) FILTER (bucket = 'discard_length_indel') AS discard_length_indel,
 count(*) FILTER (bucket = 'discard_low_quality_cds') AS discard_low_quality_cds, count(*) FILTER (bucket = 'discard_stop_codon') AS discard_stop_codon, count(*) FILTER (bucket = 'passed_qc') AS passed_qc
 FROM done WHERE status = 'assigned' GROUP BY round"""


def _p_of(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0e0))"
    t = f"(1.0e0 / (1.0e0 + 0.3275911e0 * {x}))"
    erf = f"(1.0e0 - ((((1.061405429e0 * {t} - 1.453152027e0) * {t} + 1.421413741e0) * {t} - 0.284496736e0) * {t} + 0.254829592e0) * {t} * exp(-{x} * {x}))"
    phi = f"(0.5e0 * (1.0e0 + {erf}))"
    return f"(2.0e0 * (1.0e0 - CASE WHEN {phi} >= 1 THEN 1.0e0 - 2.220446049250313e-16 ELSE {phi} END))"


def _rpm(c: str, n: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN {c}::DOUBLE / {n} * 1000000.0e0 ELSE 0.0e0 END)"


def _inv(x: str) -> str:
    return f"(CASE WHEN ({x}) = 0 THEN 'Infinity'::DOUBLE ELSE 1.0e0 / ({x}) END)"


def _stats(counts: str, keys: str, aa: str, wild: str = "", least: int | None = None) -> str:
    """Long statistics `st` over a table `{counts}` of round, keys, dna, n: one row per family, aa and round."""
    k, kc = (f"{keys}, ", f"{keys},") if keys else ("", "")
    on = f"USING ({kc} round)" if keys else "USING (round)"
    score = f"log2(({_rpm('c', 'tot')} + 0.5e0) / ({_rpm('c0', 'tot0')} + 0.5e0))"
    var = f"{_inv('c + q')} + {_inv('tot + q')} + {_inv('c0 + q0')} + {_inv('tot0 + q0')}"
    if wild:
        score = f"log2((({_rpm('c', 'tot')} + 0.5e0) / ({_rpm('wt', 'tot')} + 0.5e0)) / (({_rpm('c0', 'tot0')} + 0.5e0) / ({_rpm('wt0', 'tot0')} + 0.5e0)))"
        var = f"{_inv('c + q')} + {_inv('wt + q')} + {_inv('c0 + q0')} + {_inv('wt0 + q0')}"
    ok = "true" if least is None else f"c0 >= {least}"
    family = f"PARTITION BY {k}round" if wild or keys else "PARTITION BY round"
    return f"""
coll AS (SELECT {k}{aa} AS aa, round, dna, n FROM {counts}),
aas AS (SELECT DISTINCT {k}aa FROM coll),
rr AS (SELECT unnest(['Round_0', 'Round_1', 'Round_2']) AS round),
tots AS (SELECT {k}round, sum(n)::DOUBLE AS tot, sum(CASE WHEN {wild or 'false'} THEN n ELSE 0 END)::DOUBLE AS wt FROM {counts} GROUP BY ALL),
cells AS (SELECT {k}aa, round, coalesce(sum(n), 0)::BIGINT AS c FROM (SELECT a.*, rr.round FROM aas a, rr) LEFT JOIN coll USING ({kc} aa, round) GROUP BY ALL),
withn AS (SELECT cells.*, coalesce(tot, 0) AS tot, coalesce(wt, 0) AS wt FROM cells LEFT JOIN tots {on}),
base AS (SELECT w.*, b.c AS c0, b.tot AS tot0, b.wt AS wt0, p.c AS cp, p.tot AS totp FROM withn w JOIN withn b ON b.round = 'Round_0' AND b.aa = w.aa {'AND b.' + keys + ' = w.' + keys if keys else ''}
  LEFT JOIN withn p ON p.aa = w.aa {'AND p.' + keys + ' = w.' + keys if keys else ''} AND p.round = CASE w.round WHEN 'Round_1' THEN 'Round_0' WHEN 'Round_2' THEN 'Round_1' END),
sc AS (SELECT *, {_rpm('c', 'tot')} AS rpm, log2(({_rpm('c', 'tot')} + 0.5e0) / ({_rpm('cp', 'totp')} + 0.5e0)) AS step, {score} AS raw, ({ok}) AS eligible, 0.5e0 * tot / 1000000.0e0 AS q, 0.5e0 * tot0 / 1000000.0e0 AS q0 FROM base),
va AS (SELECT *, CASE WHEN eligible THEN (1.0e0 / ln(2.0e0)) * (1.0e0 / ln(2.0e0)) * ({var}) END AS var, coalesce(median(raw) FILTER (eligible) OVER ({family}), 0) AS med FROM sc),
zz AS (SELECT *, raw - med AS centred, CASE WHEN eligible THEN raw / greatest(sqrt(var), 1e-12) END AS z FROM va),
pp AS (SELECT *, {_p_of('z')} AS p FROM zz),
rk AS (SELECT *, row_number() OVER ({family} ORDER BY p) AS pos, count(p) OVER ({family}) AS m FROM pp),
st AS (SELECT *, CASE WHEN p IS NOT NULL THEN min(least(1.0e0, p * m / pos)) OVER ({family} ORDER BY p DESC, pos DESC ROWS UNBOUNDED PRECEDING) END AS qv FROM rk)"""


_ST = f"{_COUNTS}, {_stats('counts', '', _aa('dna'))}"


def _wide(select: str, where: str = "") -> str:
    return f"WITH {_ST} SELECT aa, {select} FROM st GROUP BY aa {where}"


def _at(column: str, i: int, digits: bool = True, name: str | None = None) -> str:
    value = f"max({column}) FILTER (round = 'Round_{i}')"
    return f"{f'round({value}, 6)' if digits else value} AS \"{name or column + str(i)}\""


_SEQ2 = "TTCGGACCTGAACGTATGC"
_SITE_READS = f"""
ev AS (SELECT event_id AS e, user_id AS u FROM events),
sense AS (SELECT e,
  (CASE WHEN e % 19 = 4 THEN 'T' || substr(b, 2) WHEN e % 27 = 5 THEN 'GTGTGTGTGTGT' ELSE b END) || 'GATTACAGATCC'
  || (CASE WHEN e % 13 = 3 THEN 'GCAACAGGCTAGAATTCCG' WHEN e % 17 = 5 THEN 'GCAACTGGCAGAATTCCG' WHEN e % 33 = 7 THEN 'ACACACACACACACACACA' ELSE 'GCAACTGGCTAGAATTCCG' END)
  || (CASE WHEN e % 4 = 1 THEN 'GCT' WHEN e % 3 = 2 AND e % 5 < 2 THEN 'TGG' ELSE {_codon('u')} END) || (CASE WHEN e % 22 = 9 THEN 'A' ELSE '' END)
  || 'GGAAGCTAGCGAATTCAAT' || 'GATTACAGATCC' || '{_SEQ2}'
  || (CASE WHEN e % 4 = 2 THEN 'TAC' ELSE {_codon('u * 5 + e % 2')} END)
  || (CASE WHEN e % 47 = 11 THEN 'CCATTGGTGGCAGCATCGGAA' ELSE 'CCATTGGTCAGCATCGGAA' END) || 'GATTACAGATCC' AS s
  FROM (SELECT *, CASE e % 3 WHEN 0 THEN 'AACCGGTTAACG' WHEN 1 THEN 'TTGGCCAATTGC' ELSE 'CTCTAGAGCTGA' END AS b FROM ev)),
quals AS (SELECT e, s, CASE WHEN e % 25 = 1 THEN repeat('$', length(s)) ELSE substr(repeat('I', 43) || repeat(CASE WHEN e % 16 = 6 THEN '/' ELSE 'I' END, 3) || repeat('I', 300), 1, length(s)) END AS q FROM sense),
turned AS (SELECT e, CASE WHEN e % 9 = 0 THEN {_rc('s')} ELSE s END AS s, CASE WHEN e % 9 = 0 THEN reverse(q) ELSE q END AS q FROM quals),
reads AS (SELECT (e % 3)::INT AS source_id, e AS ordinal, '@n' || e AS header, CASE WHEN e % 61 = 1 THEN 'X' || substr(s, 2) ELSE s END AS seq, '+' AS sep, q AS qual FROM turned),
judged AS (SELECT *, {_VALID} AS valid, {_mean_q('qual')} AS read_q FROM reads)"""


def _match(name: str, source: str, keys: str, needle: str, hay: str) -> str:
    """Table {name} (keys, d, a, b): best window of hay for needle within 3 edits, lengths within 1 of the needle's."""
    return f"""
{name}_ex AS (SELECT {keys}, {needle} AS nd, {hay} AS hy FROM {source}),
{name}_w AS (SELECT {keys}, nd, hy, s, l FROM {name}_ex, range(0, 200) t(s), range(-1, 2) v(l) WHERE NOT contains(hy, nd) AND s + length(nd) + l <= length(hy)),
{name} AS (SELECT {keys}, 0 AS d, strpos(hy, nd) - 1 AS a, strpos(hy, nd) - 1 + length(nd) AS b FROM {name}_ex WHERE contains(hy, nd)
  UNION ALL SELECT {keys}, d, s, s + length(nd) + l FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY d, s, l) AS k FROM
   (SELECT *, levenshtein(nd, substr(hy, (s + 1)::INT, (length(nd) + l)::INT)) AS d FROM {name}_w) WHERE d <= 3) WHERE k = 1)"""


_CALLS = f"""{_SITE_READS},
good AS (SELECT * FROM judged WHERE valid AND read_q >= 10),
tries AS (SELECT source_id, ordinal, 1 AS strand, upper(seq) AS s, qual AS q FROM good UNION ALL SELECT source_id, ordinal, -1, {_rc('upper(seq)')}, reverse(qual) FROM good),
heads AS (SELECT ordinal, strand, r, bc, substr(s, 1, 100) AS h FROM tries, (VALUES (0, 'AACCGGTTAACG'), (1, 'TTGGCCAATTGC'), (2, 'CTCTAGAGCTGA')) b(r, bc)),
{_match('bm', 'heads', 'ordinal, strand, r', 'bc', 'h')},
bk AS (SELECT *, row_number() OVER w AS k, lead(d) OVER w AS nxt FROM bm WINDOW w AS (PARTITION BY ordinal, strand ORDER BY d, r)),
rounded AS (SELECT t.*, CASE WHEN b.d <= 2 AND coalesce(b.nxt - b.d >= 1, true) THEN b.r END AS r FROM tries t LEFT JOIN (SELECT * FROM bk WHERE k = 1) b USING (ordinal, strand)),
sites AS (SELECT * FROM (VALUES (0, 'S1', 'GCAACTGGCTAGAATTCCG', 'GGAAGCTAGCGAATTCAAT', 'GCT'), (1, 'S2', '{_SEQ2}', 'CCATTGGTCAGCATCGGAA', 'TAC')) t(so, site, fw, rv, wt)),
spread AS (SELECT r.*, so, site, fw, rv, wt FROM rounded r, sites),
{_match('fm', 'spread', 'ordinal, strand, so', 'fw', 's')},
tails AS (SELECT sp.*, f.b AS fe, substr(sp.s, (f.b + 1)::INT) AS tl FROM spread sp JOIN fm f USING (ordinal, strand, so)),
{_match('rm', 'tails', 'ordinal, strand, so', 'rv', 'tl')},
sited AS (SELECT sp.ordinal, sp.strand, sp.r, sp.so, sp.site, sp.wt, x.a AS roi_n, substr(t.tl, 1, x.a::INT) AS roi, {_mean_q('substr(t.q, (t.fe + 1)::INT, x.a::INT)')} AS roi_q FROM spread sp LEFT JOIN rm x USING (ordinal, strand, so) LEFT JOIN tails t USING (ordinal, strand, so)),
called AS (SELECT *, CASE WHEN roi_n IS NULL THEN NULL WHEN roi_n <> 3 THEN 'discard_roi_indel' WHEN roi_q < 15 THEN 'discard_low_q_roi' WHEN roi IN ('TAA', 'TAG', 'TGA') THEN 'discard_stop_codon' ELSE 'passed_qc' END AS bucket FROM sited),
finished AS (SELECT DISTINCT ordinal FROM called WHERE strand = 1 AND r IS NOT NULL AND bucket = 'passed_qc'),
calls AS (SELECT * FROM called WHERE strand = 1 OR ordinal NOT IN (SELECT ordinal FROM finished))"""
_SITE_COUNTS = f"{_CALLS}, scounts AS (SELECT 'Round_' || r AS round, site, roi AS dna, count(*) AS n FROM calls WHERE bucket = 'passed_qc' AND r IS NOT NULL GROUP BY ALL)"
_HAPS = f"{_CALLS}, hcounts AS (SELECT round, dna, count(*) AS n FROM (SELECT 'Round_' || r AS round, string_agg(roi, '_' ORDER BY so) AS dna FROM calls WHERE bucket = 'passed_qc' AND r IS NOT NULL GROUP BY ordinal, strand, r HAVING count(*) = 2) GROUP BY ALL)"
_WILD = "(site = 'S1' AND dna = 'GCT') OR (site = 'S2' AND dna = 'TAC')"
_FIT = f"{_SITE_COUNTS}, {_stats('scounts', 'site', _aa('dna'), _WILD)}"
_HAP_AA = f"({_aa('substr(dna, 1, 3)')} || '_' || {_aa('substr(dna, 5, 3)')})"
_EFFECTIVE = "coalesce(try_cast(nullif(regexp_extract(header, 'qs:f:([0-9.]+)', 1), '') AS DOUBLE), own)"
_OWN = "-10.0e0 * log10(list_avg([pow(10.0e0, -(ord(substr(qq, i::INT, 1)) - 33) / 10.0e0) FOR i IN range(1, length(qq) + 1)]))"
_DORADO = f"{_READS}, dq AS (SELECT *, {_OWN} AS own FROM (SELECT *, CASE WHEN length(qual) > 60 THEN substr(qual, 61) ELSE qual END AS qq FROM reads)), eff AS (SELECT *, {_EFFECTIVE} AS q FROM dq)"
_DEMUX_SELECT = "SELECT ordinal, status, strand, round, bucket, CASE WHEN bucket = 'passed_qc' THEN cds END AS dna FROM done"
_RANKED = f"{_AAC}, ra AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY n DESC, aa) AS rank, count(*) OVER (PARTITION BY round) AS rows FROM aac)"
_T22 = f"{_ST}, w AS (SELECT aa, max(c) FILTER (round = 'Round_2')::DOUBLE AS a, max(c) FILTER (round = 'Round_0')::DOUBLE AS b, max(tot) FILTER (round = 'Round_2') AS t2, max(tot) FILTER (round = 'Round_0') AS t0 FROM st GROUP BY aa), t AS (SELECT aa, a, b, t2 - a AS c, t0 - b AS d FROM w)"
_ERFC_X = "sqrt(chi / 2)"
_ERFC_T = f"(1.0e0 / (1.0e0 + 0.5e0 * {_ERFC_X}))"
_ERFC = f"({_ERFC_T} * exp(-(chi / 2) - 1.26551223e0 + {_ERFC_T} * (1.00002368e0 + {_ERFC_T} * (0.37409196e0 + {_ERFC_T} * (0.09678418e0 + {_ERFC_T} * (-0.18628806e0 + {_ERFC_T} * (0.27886807e0 + {_ERFC_T} * (-1.13520398e0 + {_ERFC_T} * (1.48851587e0 + {_ERFC_T} * (-0.82215223e0 + {_ERFC_T} * 0.17087277e0))))))))))"
_PLOT = f"{_ST}, w AS (SELECT aa, round(max(raw) FILTER (round = 'Round_2'), 6) AS score, round(max(qv) FILTER (round = 'Round_2'), 6) AS q, max(c) FILTER (round = 'Round_0') AS c0, max(c) FILTER (round = 'Round_2') AS c2, round(max(centred) FILTER (round = 'Round_2'), 6) AS cen FROM st GROUP BY aa)"
_HITS = ", ".join(f"count(*) FILTER (isfinite(qv) AND qv < {t}) AS hits_{n}" for t, n in ((0.05, "05"), (0.01, "01")))


def _matrix() -> str:
    names = ["Round_0", "Round_1", "Round_2"]
    columns = ["aa AS \"Peptide_Seq\"", "(SELECT dom FROM dm WHERE dm.aa = st.aa) AS \"Dominant_DNA_Seq\""]
    for metric, name, first in (("c", "Count_{}", 0), ("rpm", "RPM_{}", 0), ("step", "Enrich_Step_{}_vs_{p}", 1), ("centred", "Centered_Enrich_{}_vs_Round_0", 1), ("z", "Z_Enrich_{}_vs_Round_0", 1), ("p", "Pval_Enrich_{}_vs_Round_0", 1), ("qv", "FDR_q_{}_vs_Round_0", 1), ("var", "Var_Enrich_{}_vs_Round_0", 1)):
        columns += [_at(metric, i, metric != "c", name.format(r, p=names[i - 1])) for i, r in enumerate(names) if i >= first]
    return f"WITH {_ST}, dt AS (SELECT aa, dna, sum(n) AS t FROM coll GROUP BY ALL), dm AS (SELECT aa, arg_min(dna, (-t, dna)) AS dom FROM dt GROUP BY aa) SELECT {', '.join(columns)} FROM st GROUP BY aa"


def _hit(codon: str, wild: str) -> str:
    """The path over a substituted codon: M or X for each base."""
    return " || ".join(f"CASE substr({codon}, {i}, 1) WHEN '{wild[i - 1]}' THEN 'M' ELSE 'X' END" for i in (1, 2, 3))


def _runs(op: str) -> str:
    return f"len(regexp_extract_all(ops, '{op}+'))"


def _times(op: str) -> str:
    return f"length(regexp_replace(ops, '[^{op}]', '', 'g'))"


# How each amplicon was made is known, so its alignment can be stated: substituted codons are mismatches, and the
# inserted or deleted bases and the cut end are gaps where they were made. Nothing here aligns anything.
_AMPLICONS = f"""
ev AS (SELECT event_id AS e, user_id AS u FROM events),
built AS (SELECT e, (e % 41 = 8) AS short, (e % 43 = 9) AND NOT (e % 41 = 8) AS twice, (e % 47 = 3) AND NOT (e % 41 = 8 OR e % 43 = 9) AS flanked,
  CASE WHEN e % 11 = 4 THEN 'lost' WHEN e % 13 = 5 THEN 'more' WHEN e % 17 = 6 THEN 'one' ELSE 'same' END AS near,
  CASE WHEN e % 4 = 1 THEN '{_REF[60:63]}' WHEN e % 3 = 2 AND e % 2 = 0 THEN 'TGG' ELSE {_codon('u')} END AS c1,
  CASE WHEN e % 4 = 2 THEN '{_REF[180:183]}' ELSE {_codon('u * 5 + e % 2')} END AS c2 FROM ev),
wholes AS (SELECT *, '{_REF[:60]}' || c1 || (CASE near WHEN 'lost' THEN '{_REF[63:110]}' WHEN 'more' THEN '{_REF[63:90]}AC{_REF[90:120]}' WHEN 'one' THEN '{_REF[63:80]}{_REF[81:120]}' ELSE '{_REF[63:120]}' END)
  || '{_REF[120:180]}' || c2 || '{_REF[183:]}' AS w FROM built),
senses AS (SELECT *, CASE WHEN short THEN substr(w, 1, 200) WHEN twice THEN w || w WHEN flanked THEN 'GATTACA' || w || 'CCCTTT' ELSE w END AS s FROM wholes),
quals AS (SELECT *, CASE WHEN e % 31 = 3 THEN repeat('$', length(s)) WHEN e % 16 = 6 THEN substr(repeat('I', 60) || repeat(chr(39), 3) || repeat('I', 700), 1, length(s)) ELSE repeat('I', length(s)) END AS sq FROM senses),
turned AS (SELECT *, CASE WHEN e % 9 = 0 THEN {_rc('s')} ELSE s END AS t, CASE WHEN e % 9 = 0 THEN reverse(sq) ELSE sq END AS qual FROM quals),
reads AS (SELECT *, (e % 3)::INT AS source_id, e AS ordinal, '@t' || (CASE WHEN e % 50 = 0 THEN e + 30 ELSE e END) AS header, CASE WHEN e % 53 = 10 THEN 'X' || substr(t, 2) ELSE t END AS seq, '+' AS sep FROM turned),
judged AS (SELECT *, {_VALID} AS valid, CASE WHEN length(qual) > 60 THEN substr(qual, 61) ELSE qual END AS qq FROM reads),
placed AS (SELECT *, {_OWN} AS read_q, row_number() OVER (PARTITION BY source_id, header, valid ORDER BY ordinal) AS k FROM judged),
kept AS (SELECT *, CASE WHEN NOT valid THEN 'malformed_fastq' WHEN k > 1 THEN 'duplicate_read_id' WHEN read_q < 10 THEN 'low_read_q' WHEN length(seq) >= 450 THEN 'concatemer_or_chimera' END AS early FROM placed),
paths AS (SELECT *, repeat('M', 60) || {_hit('c1', _REF[60:63])} || (CASE near WHEN 'lost' THEN repeat('M', 47) || repeat('D', 10) WHEN 'more' THEN repeat('M', 27) || 'II' || repeat('M', 30) WHEN 'one' THEN repeat('M', 17) || 'D' || repeat('M', 39) ELSE repeat('M', 57) END)
  || repeat('M', 60) || {_hit('c2', _REF[180:183])} || repeat('M', 117) AS path, CASE near WHEN 'lost' THEN 10 WHEN 'one' THEN 1 ELSE 0 END AS gone, CASE near WHEN 'more' THEN 2 ELSE 0 END AS more FROM kept),
whole_ops AS (SELECT *, CASE WHEN early IS NULL THEN CASE WHEN short THEN substr(path, 1, (200 + gone)::INT) || repeat('D', (100 - gone + more)::INT) ELSE path END END AS ops FROM paths),
tallied AS (SELECT *, {_times('M')} AS nm, {_times('X')} AS nx, {_times('D')} AS nd, {_times('I')} AS ni FROM whole_ops),
measured AS (SELECT *, (nm + nx)::DOUBLE / (nm + nx + nd) AS coverage, nm::DOUBLE / length(ops) AS identity, (nm - (6 - nx))::DOUBLE / (nm - (6 - nx) + nd + ni) AS protected_identity FROM tallied),
aligned AS (SELECT *, coalesce(early, CASE WHEN coverage < 0.9 THEN 'partial_reference' WHEN identity < 0.85 THEN 'low_alignment_identity' WHEN protected_identity < 0.95 THEN 'low_protected_identity' WHEN nd + ni > 30 THEN 'protected_indel' END) AS lost FROM measured),
two AS (SELECT * FROM (VALUES (0, 'T1', '{_REF[60:63]}', 60), (1, 'T2', '{_REF[180:183]}', 180)) t(so, site, wt, start0)),
sited AS (SELECT a.*, so, site, wt, CASE so WHEN 0 THEN c1 ELSE c2 END AS dna, list_min([ord(substr(sq, (start0 + (CASE WHEN flanked THEN 7 ELSE 0 END) + (CASE so WHEN 0 THEN 0 ELSE more - gone END) + j)::INT, 1)) - 33 FOR j IN range(1, 4)])::DOUBLE AS min_q,
  lost IS NOT NULL AND so = 0 AND near <> 'one' AS rescued FROM aligned a, two WHERE early IS NULL),
tcalls AS (SELECT *, CASE WHEN min_q < 15 THEN 'low_quality' WHEN dna = wt THEN 'wt' WHEN dna IN ('TAA', 'TAG', 'TGA') THEN 'stop_codon' ELSE 'variant' END AS status, min_q >= 15 AND (lost IS NULL OR rescued) AS counted FROM sited),
linked AS (SELECT ordinal, string_agg(dna, '|' ORDER BY so) AS haplotype FROM tcalls WHERE lost IS NULL GROUP BY ordinal HAVING min(min_q) >= 15)"""
_TCOUNTS = f"{_AMPLICONS}, tc AS (SELECT 'Round_' || source_id AS round, site, dna, count(*) AS n FROM tcalls WHERE counted GROUP BY ALL)"
_CCOUNTS = f"{_AMPLICONS}, cc AS (SELECT 'Round_' || source_id AS round, haplotype AS dna, count(*) AS n FROM linked JOIN reads USING (ordinal) GROUP BY ALL)"
_BAR_AA = f"({_aa('substr(dna, 1, 3)')} || '|' || {_aa('substr(dna, 5, 3)')})"
_PRIMARY = ("malformed_fastq", "duplicate_read_id", "low_read_q", "concatemer_or_chimera", "alignment_failed", "partial_reference", "low_alignment_identity", "low_protected_identity", "protected_indel")
_LOST = ", ".join(f"count(*) FILTER (lost = '{x}') AS {x}" for x in _PRIMARY)


def _target_matrix(ctes: str, counts: str, keys: str, aa: str, head: tuple[str, ...]) -> str:
    """The exported matrix of engine C: names of the key, variant and dominant columns, then a column per metric."""
    names = ["Round_0", "Round_1", "Round_2"]
    k, of = (f"{keys}, ", f"dm.{keys} = st.{keys} AND ") if keys else ("", "")
    columns = [f'{keys} AS "{head[0]}"'] if keys else []
    columns += [f'aa AS "{head[-2]}"', f'any_value((SELECT dom FROM dm WHERE {of}dm.aa = st.aa)) AS "{head[-1]}"', 'bool_and(eligible) AS "Score_Eligible"']
    metrics = (("c", "Count_{}", 0), ("rpm", "RPM_{}", 0), ("raw", "Enrichment_{}", 1), ("centred", "Centered_Enrichment_{}", 1), ("z", "Z_Enrichment_{}", 1), ("p", "Pval_Enrichment_{}", 1), ("qv", "FDR_q_{}", 1), ("var", "Var_Enrichment_{}", 1))
    for metric, name, first in metrics:
        columns += [_at(metric, i, metric != "c", name.format(r) + ("_vs_Round_0" if first else "")) for i, r in enumerate(names) if i >= first]
    dominant = f"dt AS (SELECT {k}aa, dna, sum(n) AS t FROM coll GROUP BY ALL), dm AS (SELECT {k}aa, arg_min(dna, (-t, dna)) AS dom FROM dt GROUP BY ALL)"
    return f"WITH {ctes}, {_stats(counts, keys, aa, least=10)}, {dominant} SELECT {', '.join(columns)} FROM st GROUP BY {k}aa"


_CHOOSE = "(lgamma({0} + 1.0e0) - lgamma({1} + 1.0e0) - lgamma({0} - {1} + 1.0e0))"
_RIGHT_TAIL = f"list_sum([exp({_CHOOSE.format('(a + c)', 'k')} + {_CHOOSE.format('(b + d)', '(a + b - k)')} - {_CHOOSE.format('n', '(a + b)')}) FOR k IN range(a::BIGINT, least(a + b, a + c)::BIGINT + 1)])"


_PAIR = f"{_ST}, w AS (SELECT aa, max(c) FILTER (round = 'Round_2')::DOUBLE AS a, max(c) FILTER (round = 'Round_1')::DOUBLE AS b, max(tot) FILTER (round = 'Round_2') AS ta, max(tot) FILTER (round = 'Round_1') AS tb FROM st GROUP BY aa), t AS (SELECT aa, a, b, ta - a AS c, tb - b AS d, log2(({_rpm('a', 'ta')} + 0.5e0) / ({_rpm('b', 'tb')} + 0.5e0)) AS fc FROM w), x AS (SELECT *, a + b + c + d AS n, (a + b) * (c + d) * (a + c) * (b + d) AS mg, abs(a * d - b * c) - (a + b + c + d) / 2 AS ex FROM t), y AS (SELECT *, mg > 0 AND a * n > (a + b) * (a + c) AND ex > 0 AS ok, CASE WHEN mg > 0 AND ex > 0 THEN ex * ex * n / mg END AS chi FROM x), pv AS (SELECT aa, fc, CASE WHEN least(a, b, c, d) < 5 THEN CASE WHEN a + b = 0 OR a + c = 0 OR b + d = 0 THEN 1 ELSE least(1, {_RIGHT_TAIL}) END WHEN ok THEN 0.5e0 * {_ERFC} ELSE 1 END AS p FROM y), pr AS (SELECT *, row_number() OVER (ORDER BY p) AS pos, count(*) OVER () AS m FROM pv), pq AS (SELECT aa, fc, p, min(least(1.0e0, p * m / pos)) OVER (ORDER BY p DESC, pos DESC ROWS UNBOUNDED PRECEDING) AS q FROM pr)"


ORACLES = {
    "read_validity": f"WITH {_READS} SELECT ordinal, valid FROM judged",
    "mean_phred_filter": f"WITH {_READS} SELECT ordinal, round({_mean_q('qual')}, 6) AS read_q FROM reads WHERE round({_mean_q('qual')}, 6) >= 20",
    "revcomp": f"WITH {_READS} SELECT ordinal, {_rc('upper(seq)')} AS rc FROM reads",
    "gc_percent": f"WITH {_READS} SELECT ordinal, round(100.0e0 * len(list_filter(string_split(upper(seq), ''), lambda x: x IN ('G', 'C'))) / length(seq), 6) AS gc FROM reads",
    "translate_cds": f"WITH {_DONE} SELECT ordinal, cds, {_aa('cds')} AS aa FROM done WHERE cds IS NOT NULL",
    "stop_filter": f"WITH {_DONE} SELECT ordinal, {_no_stop('cds')} AS no_stop FROM done WHERE cds IS NOT NULL",
    "dorado_read_q": f"WITH {_DORADO} SELECT ordinal, round(q, 6) AS effective, round(own, 6) AS recalculated, CASE WHEN contains(header, 'qs:f:') THEN round(q - own, 6) END AS delta, CASE WHEN contains(header, 'qs:f:') THEN 'header' ELSE 'recalculated' END AS source FROM eff",
    "barcode_score": f"WITH {_DONE} SELECT ordinal, pen AS penalty FROM done WHERE status = 'assigned'",
    "demux_assign": f"WITH {_DONE} {_DEMUX_SELECT}",
    "demux_per_round": f"WITH {_assign(bound=True)} {_DEMUX_SELECT}",
    "rc_retry_reason": f"WITH {_DONE} SELECT fv AS fw_verdict, bv AS rc_verdict, status, count(*) AS n FROM stated WHERE valid AND read_q >= 20 GROUP BY ALL",
    "funnel_by_round": f"WITH {_DONE} {_FUNNEL}",
    "funnel_strict": f"WITH {_assign(read_q=10.0, adaptive=False)} {_FUNNEL}",
    "funnel_global": f"WITH {_DONE} SELECT count(*) AS total_reads, {', '.join(f'''count(*) FILTER (status = '{k}') AS {k}''' for k in ('malformed_fastq', 'low_quality', 'no_anchor', 'barcode_mismatch', 'ambiguous'))}, count(*) FILTER (status <> 'assigned') AS global_unassigned FROM done",
    "variant_counts": f"WITH {_COUNTS} SELECT round, dna, n FROM counts",
    "shard_union_invariance": f"WITH {_COUNTS} SELECT round, dna, n FROM counts",
    "aa_collapse": f"WITH {_AAC} SELECT round, aa, n FROM aac",
    "dominant_dna": f"WITH {_COUNTS}, t AS (SELECT {_aa('dna')} AS aa, dna, sum(n) AS s FROM counts GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY aa ORDER BY s DESC, dna) AS k FROM t) SELECT aa, dna AS dominant FROM k WHERE k = 1",
    "rpm_matrix": _wide(", ".join(_at("rpm", i) for i in range(3))),
    "enrich_step": _wide(", ".join(_at("step", i) for i in (1, 2))),
    "enrich_centered": _wide(", ".join(_at("centred", i) for i in (1, 2))),
    "var_enrich": _wide(", ".join(_at("var", i) for i in (1, 2))),
    "wald_z_p": _wide(", ".join(_at(c, i) for i in (1, 2) for c in ("z", "p"))),
    "bh_fdr": _wide(", ".join(_at("qv", i, name=f"q{i}") for i in (1, 2))),
    "master_matrix": _matrix(),
    "library_median": f"WITH {_ST} SELECT {_at('med', 1, name='m1')}, {_at('med', 2, name='m2')} FROM st",
    "fdr_hit_counts": f"WITH {_ST} SELECT CASE round WHEN 'Round_1' THEN 'q1' ELSE 'q2' END AS comparison, {_HITS} FROM st WHERE round <> 'Round_0' GROUP BY round",
    "banded_match": f"WITH {_SITE_READS}, src AS (SELECT ordinal, upper(seq) AS hy0 FROM reads), {_match('mm', 'src', 'ordinal', chr(39) + 'GCAACTGGCTAGAATTCCG' + chr(39), 'hy0')} SELECT ordinal, d::INT AS score, a::INT AS start, b::INT AS \"end\" FROM src LEFT JOIN mm USING (ordinal)",
    "ssm_sites": f"WITH {_CALLS} SELECT 'Round_' || r AS round, site, count(bucket) AS anchor_found, {', '.join(f'''count(*) FILTER (bucket = '{k}') AS {k}''' for k in ('discard_roi_indel', 'discard_low_q_roi', 'discard_frameshift', 'discard_stop_codon', 'passed_qc'))}, count(*) FILTER (bucket = 'passed_qc' AND roi = wt) AS wt_count FROM calls WHERE r IS NOT NULL GROUP BY ALL",
    "ssm_attempt_funnel": f"WITH {_CALLS}, per AS (SELECT ordinal, strand, any_value(r) AS r, count(*) FILTER (bucket = 'passed_qc') AS n FROM calls GROUP BY ALL) SELECT (SELECT count(*) FROM judged WHERE NOT valid) AS malformed_fastq, (SELECT count(*) FROM judged WHERE valid AND read_q < 10) AS low_quality_read, count(*) FILTER (r IS NULL) AS barcode_mismatch, count(*) FILTER (r IS NOT NULL AND n = 0) AS no_site_extracted FROM per",
    "ssm_site_counts": f"WITH {_SITE_COUNTS} SELECT round, site, dna, n FROM scounts",
    "ssm_haplotypes": f"WITH {_HAPS} SELECT round, dna, n FROM hcounts",
    "wt_fitness": f"WITH {_FIT} SELECT site, aa, {', '.join(_at('raw', i) for i in range(3))}, {_at('centred', 2)}, {_at('var', 2)} FROM st GROUP BY site, aa",
    "site_scoped_fdr": f"WITH {_FIT} SELECT site, aa, {_at('p', 1)}, {_at('qv', 1, name='q1')}, {_at('p', 2)}, {_at('qv', 2, name='q2')} FROM st GROUP BY site, aa",
    "eligibility_gate": f"WITH {_SITE_COUNTS}, {_stats('scounts', 'site', _aa('dna'), least=10)} SELECT site, aa, bool_and(eligible) AS eligible, {_at('centred', 2)}, {_at('z', 2)}, {_at('p', 2)}, {_at('qv', 2, name='q2')} FROM st GROUP BY site, aa",
    "haplotype_fitness": f"WITH {_HAPS}, {_stats('hcounts', '', _HAP_AA, 'dna = ' + chr(39) + 'GCT_TAC' + chr(39))}, ht AS (SELECT aa, dna, sum(n) AS t FROM coll GROUP BY ALL), hd AS (SELECT aa, arg_min(dna, (-t, dna)) AS dominant FROM ht GROUP BY aa) SELECT aa, any_value(dominant) AS dominant, {_at('c', 0, False)}, {_at('c', 1, False)}, {_at('c', 2, False)}, {_at('raw', 2)}, {_at('qv', 2, name='q2')} FROM st JOIN hd USING (aa) GROUP BY aa",
    "readid_dedup": f"WITH {_READS}, ids AS (SELECT *, split_part(substr(header, 2), ' ', 1) AS read_id, (source_id % 3)::INT AS round_idx FROM judged), f AS (SELECT *, row_number() OVER (PARTITION BY round_idx, read_id, valid ORDER BY source_id, ordinal) AS k FROM ids) SELECT ordinal, round_idx, read_id, valid AND k > 1 AS duplicate FROM f",
    "exact_codon_table": f"WITH {_SITE_COUNTS}, t AS (SELECT site, round, sum(n) AS tot FROM scounts GROUP BY ALL) SELECT site, dna, {_aa('dna')} AS aa, {', '.join(f'''coalesce(sum(n) FILTER (round = 'Round_{i}'), 0)::BIGINT AS \"Count_Round_{i}\", round(coalesce(sum(n * 1000000.0e0 / tot) FILTER (round = 'Round_{i}'), 0), 6) AS \"RPM_Round_{i}\"''' for i in range(3))} FROM scounts JOIN t USING (site, round) GROUP BY site, dna",
    "exact_combination_table": f"WITH {_HAPS}, t AS (SELECT round, sum(n) AS tot FROM hcounts GROUP BY ALL) SELECT dna, {_HAP_AA} AS aa, {', '.join(f'''coalesce(sum(n) FILTER (round = 'Round_{i}'), 0)::BIGINT AS \"Count_Round_{i}\", round(coalesce(sum(n * 1000000.0e0 / tot) FILTER (round = 'Round_{i}'), 0), 6) AS \"RPM_Round_{i}\"''' for i in range(3))} FROM hcounts JOIN t USING (round) GROUP BY dna",
    "combination_label": f"WITH {_SITE_COUNTS}, d AS (SELECT DISTINCT site, {_aa('dna')} AS aa FROM scounts) SELECT site, aa, CASE site WHEN 'S1' THEN 'R233' || aa ELSE 'loop:' || aa END AS label FROM d",
    "gini": f"WITH {_AAC}, o AS (SELECT round, n, row_number() OVER (PARTITION BY round ORDER BY n) AS i, count(*) OVER (PARTITION BY round) AS k FROM aac) SELECT round, round(2.0e0 * sum(i * n) / (any_value(k) * sum(n)) - (any_value(k) + 1.0e0) / any_value(k), 6) AS gini FROM o GROUP BY round",
    "power_law_slope": f"WITH {_RANKED} SELECT round, round(regr_slope(log10(n::DOUBLE), log10(rank::DOUBLE)), 6) AS slope FROM ra WHERE rank <= floor(rows * 0.8e0) GROUP BY round",
    "count_histogram": f"WITH {_AAC}, v AS (SELECT round, log10(n::DOUBLE) AS v FROM aac WHERE n > 0), b AS (SELECT round, min(v) AS lo, max(v) AS hi FROM v GROUP BY round) SELECT round, least(floor((v - lo) / ((hi - lo) / 24)), 23)::INT AS bin, count(*) AS n_variants FROM v JOIN b USING (round) GROUP BY ALL",
    "histogram_fit": f"WITH {_AAC} SELECT round, count(*) AS n_values, count(*) >= 5 AND stddev_samp(log10(n::DOUBLE)) > 0 AS fitted, round(avg(log10(n::DOUBLE)), 6) AS mean, round(stddev_samp(log10(n::DOUBLE)), 6) AS sd FROM aac GROUP BY round",
    "logo_information": f"WITH {_AAC}, top AS (SELECT aa FROM aac WHERE round = 'Round_2' ORDER BY n DESC, aa LIMIT 100), l AS (SELECT (i - 1)::INT AS position, substr(aa, i::INT, 1) AS letter, count(*) AS k FROM top, range(1, 4) t(i) GROUP BY ALL), s AS (SELECT *, k::DOUBLE / sum(k) OVER (PARTITION BY position) AS f FROM l), b AS (SELECT *, f * (log2(20.0e0) + sum(f * log2(f)) OVER (PARTITION BY position)) AS bits FROM s) SELECT position, letter, round(bits, 6) AS bits FROM b WHERE bits > 0.005",
    "target_logo": f"WITH {_SITE_COUNTS}, k AS (SELECT site, {_aa('dna')} AS aa, sum(n) AS k FROM scounts GROUP BY ALL), s AS (SELECT *, k::DOUBLE / sum(k) OVER (PARTITION BY site) AS share FROM k) SELECT site, aa, round(share, 6) AS share, round(share * (log2(20.0e0) + sum(share * log2(share)) OVER (PARTITION BY site)), 6) AS bits FROM s",
    "rank_abundance": f"WITH {_RANKED}, w AS (SELECT DISTINCT round, floor(exp(i / 200.0e0 * ln(rows::DOUBLE)) + 0.5e0)::INT AS rank FROM (SELECT round, max(rows) AS rows FROM ra GROUP BY round), range(0, 201) t(i)) SELECT round, rank::INT AS rank, n FROM ra JOIN w USING (round, rank)",
    "top_bottom_n": f"WITH {_PLOT}, a AS (SELECT aa, cen AS score, row_number() OVER (ORDER BY cen DESC, aa)::INT AS place, 'top' AS side FROM w UNION ALL SELECT aa, cen, row_number() OVER (ORDER BY cen, aa DESC)::INT, 'bottom' FROM w) SELECT * FROM a WHERE place <= 20",
    "volcano_points": f"WITH {_PLOT}, r AS (SELECT aa, score, q, row_number() OVER (ORDER BY score DESC, aa)::INT AS rank, q < 0.05 AND score > 1 AS significant FROM w), k AS (SELECT *, rank <= 20 OR significant AS keep FROM r), g AS (SELECT *, sum(CASE WHEN keep THEN 0 ELSE 1 END) OVER (ORDER BY rank) AS pos, count(*) FILTER (keep) OVER () AS kept, count(*) FILTER (NOT keep) OVER () AS others FROM k) SELECT aa, score, q, rank, significant, round(CASE WHEN q <= 0 THEN 300 WHEN q >= 1 THEN 0 ELSE -log10(q) END, 6) AS neg_log10_q FROM g WHERE keep OR (pos - 1) % greatest(1, ceil(others / greatest(1500 - kept, 1)::DOUBLE))::INT = 0",
    "scatter_points": f"WITH {_PLOT}, r AS (SELECT aa, c0, c2, row_number() OVER (ORDER BY c2 DESC, aa)::INT AS rank, count(*) OVER () AS k FROM w WHERE c0 > 0 OR c2 > 0) SELECT aa, c0, c2, rank FROM r WHERE rank <= 20 OR (rank - 21) % greatest(1, ceil((k - 20) / 1980.0e0))::INT = 0",
    "yates_chi2": f"WITH {_T22}, x AS (SELECT *, a + b + c + d AS n, (a + b) * (c + d) * (a + c) * (b + d) AS mg, abs(a * d - b * c) - (a + b + c + d) / 2 AS ex FROM t), y AS (SELECT *, mg > 0 AND a * n > (a + b) * (a + c) AND ex > 0 AS ok, CASE WHEN mg > 0 AND ex > 0 THEN ex * ex * n / mg END AS chi FROM x) SELECT aa, round(CASE WHEN ok THEN 0.5e0 * {_ERFC} ELSE 1 END, 6) AS p FROM y",
    "sankey_links": f"WITH {_DONE} SELECT round AS source, bucket AS target, count(*) AS reads FROM done WHERE status = 'assigned' GROUP BY ALL",
    "q_quantiles": f"WITH {_DORADO} SELECT source_id, {', '.join(f'round(quantile_cont(q, {p}), 6) AS {n}' for p, n in ((0, 'q_min'), (0.25, 'q_25'), (0.5, 'q_50'), (0.75, 'q_75'), (1, 'q_max')))} FROM eff GROUP BY source_id",
    "zero_coverage": "SELECT 'Round_1' AS round, 'S2' AS site",
    "round_totals": f"WITH {_AAC} SELECT round, sum(n)::BIGINT AS reads, count(*) AS distinct_aa FROM aac GROUP BY round",
    "fisher_exact": f"WITH {_T22}, x AS (SELECT *, a + b + c + d AS n, (a + b) * (c + d) * (a + c) * (b + d) AS mg, abs(a * d - b * c) - (a + b + c + d) / 2 AS ex FROM t), y AS (SELECT *, mg > 0 AND a * n > (a + b) * (a + c) AND ex > 0 AS ok, CASE WHEN mg > 0 AND ex > 0 THEN ex * ex * n / mg END AS chi FROM x) SELECT aa, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d, round(CASE WHEN least(a, b, c, d) < 5 THEN CASE WHEN a + b = 0 OR a + c = 0 OR b + d = 0 THEN 1 ELSE least(1, {_RIGHT_TAIL}) END WHEN ok THEN 0.5e0 * {_ERFC} ELSE 1 END, 9) AS p FROM y",
    "targeted_align": f"WITH {_AMPLICONS} SELECT ordinal, lost AS drop, CASE WHEN early IS NULL THEN CASE WHEN ordinal % 9 = 0 THEN -1 ELSE 1 END END::INT AS strand, (2 * nm - 3 * nx - 4 * ({_runs('D')} + {_runs('I')}) - nd - ni)::BIGINT AS score, CASE WHEN early IS NULL THEN CASE WHEN flanked THEN 7 ELSE 0 END END::INT AS read_start, CASE WHEN early IS NULL THEN length(s) - CASE WHEN flanked THEN 6 ELSE 0 END END::INT AS read_end, array_to_string([length(x) || x[1] FOR x IN regexp_extract_all(ops, 'M+|X+|I+|D+')], '') AS cigar, CASE WHEN coverage < 0.98 THEN 192 WHEN coverage IS NOT NULL THEN 24 END::INT AS band, CASE WHEN early IS NULL THEN lost IS NULL END AS qc_passed, haplotype FROM aligned LEFT JOIN linked USING (ordinal)",
    "targeted_calls": f"WITH {_AMPLICONS} SELECT ordinal, site, status, dna, {_aa('dna')} AS aa, min_q, counted, rescued FROM tcalls",
    "targeted_funnel": f"WITH {_AMPLICONS} SELECT source_id, count(*) AS total_reads, count(*) FILTER (early IS NULL) AS aligned, count(*) FILTER (lost IS NULL) AS full_qc_passed, {_LOST} FROM aligned GROUP BY source_id",
    "targeted_site_funnel": f"WITH {_AMPLICONS} SELECT source_id AS round_idx, site, count(*) FILTER (status = 'low_quality') AS low_quality, 0::BIGINT AS not_covered, 0::BIGINT AS ambiguous, count(*) FILTER (status = 'stop_codon') AS stop_codon, 0::BIGINT AS target_indel, count(*) FILTER (counted) AS passed_qc, count(*) FILTER (counted AND lost IS NULL) AS callable_full, count(*) FILTER (counted AND lost IS NOT NULL) AS callable_rescued, count(*) FILTER (counted AND {_aa('dna')} = {_aa('wt')}) AS wt_count FROM tcalls GROUP BY source_id, site",
    "targeted_matrix": _target_matrix(_TCOUNTS, "tc", "site", _aa("dna"), ("Target", "Variant_AA", "Dominant_DNA")),
    "targeted_combinations": _target_matrix(_CCOUNTS, "cc", "", _BAR_AA, ("Combination_AA", "Combination_DNA")),
    "pairwise_tests": f"WITH {_PAIR} SELECT aa, round(fc, 6) AS log2fc, round(p, 9) AS p, round(q, 9) AS q FROM pq",
    "volcano_recomputed": f"WITH {_PAIR}, w2 AS (SELECT aa, round(fc, 6) AS score, round(q, 6) AS q FROM pq), r AS (SELECT aa, score, q, row_number() OVER (ORDER BY score DESC, aa)::INT AS rank, q < 0.05 AND score > 1 AS significant FROM w2), k AS (SELECT *, rank <= 20 OR significant AS keep FROM r), g AS (SELECT *, sum(CASE WHEN keep THEN 0 ELSE 1 END) OVER (ORDER BY rank) AS place, count(*) FILTER (keep) OVER () AS kept, count(*) FILTER (NOT keep) OVER () AS others FROM k) SELECT aa, score, q, rank, significant, round(CASE WHEN q <= 0 THEN 300 WHEN q >= 1 THEN 0 ELSE -log10(q) END, 6) AS neg_log10_q FROM g WHERE keep OR (place - 1) % greatest(1, ceil(others / greatest(1500 - kept, 1)::DOUBLE))::INT = 0",
    "count_sample": f"WITH {_RANKED}, pos AS (SELECT * FROM ra WHERE n > 0) SELECT round, n, 'top' AS kind FROM pos WHERE rank <= 20 UNION ALL SELECT round, n, 'sample' FROM pos WHERE rows <= 30000",
    "matrix_preview": f'SELECT * FROM ({_matrix()}) ORDER BY "Centered_Enrich_Round_2_vs_Round_0" DESC, "Peptide_Seq" LIMIT 200',
    "target_fdr_hits": f"WITH {_TCOUNTS}, {_stats('tc', 'site', _aa('dna'), least=10)} SELECT site AS \"Target\", 'FDR_q_' || round || '_vs_Round_0' AS comparison, {_HITS} FROM st WHERE eligible AND round <> 'Round_0' GROUP BY site, round",
    "site_fdr_hits": f"WITH {_FIT} SELECT site, 'q2' AS comparison, {_HITS} FROM st WHERE round = 'Round_2' GROUP BY site",
    "alignment_events": f"""WITH {_AMPLICONS}, cells AS (SELECT ordinal, s, flanked, ops, i, substr(ops, i::INT, 1) AS op, length(regexp_replace(substr(ops, 1, (i - 1)::INT), 'I', '', 'g')) AS ref_pos,
        CASE WHEN flanked THEN 7 ELSE 0 END + length(regexp_replace(substr(ops, 1, (i - 1)::INT), 'D', '', 'g')) AS read_pos, substr(ops, (i - 1)::INT, 1) AS before, length(regexp_extract(substr(ops, i::INT), '^(I+|D+|.)')) AS run
        FROM aligned, range(1, 400) t(i) WHERE early IS NULL AND i <= length(ops) AND regexp_matches(ops, '[XID]'))
        SELECT ordinal, CASE op WHEN 'X' THEN 'substitution' WHEN 'I' THEN 'insertion' ELSE 'deletion' END AS type, ref_pos::INT AS ref_pos, read_pos::INT AS read_pos,
        CASE op WHEN 'I' THEN '' ELSE substr('{_REF}', (ref_pos + 1)::INT, run::INT) END AS ref, CASE op WHEN 'D' THEN '' ELSE substr(s, (read_pos + 1)::INT, run::INT) END AS alt
        FROM cells WHERE op = 'X' OR (op IN ('I', 'D') AND (i = 1 OR before <> op))""",
}
