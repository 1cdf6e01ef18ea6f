"""SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from trackledger.llm.decontamination import MATCH, SHORTEST_TOLERANT, WINDOW
from trackledger.llm.jaccard_join import PERCENT, WORDS
from trackledger.llm.licenses import PHRASES, RAREST, TEMPLATES, VOTES
from trackledger.llm.substring_dedup import WINDOW as DEDUP_WINDOW


def license_scan() -> str:
    """The license scan as relations: words, postings, aligned hits, verified templates."""
    templates = ", ".join(f"({t}, '{label}', {notice.split()!r})" for t, (label, notice, _) in enumerate(TEMPLATES))
    phrases = ", ".join(f"({t}, {p.split()!r})" for t, (_, _, own) in enumerate(TEMPLATES) for p in own)
    base = ", ".join(f"({k}, '{label}', {p.split()!r})" for k, (p, label) in enumerate(PHRASES))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''),'{upper}','{lower}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x<>'') AS w FROM documents),
t AS (SELECT * FROM (VALUES {templates}) AS v(t, label, words)), ph AS (SELECT * FROM (VALUES {phrases}) AS v(t, words)), bp AS (SELECT * FROM (VALUES {base}) AS v(k, label, words)),
vocabulary AS (SELECT DISTINCT unnest(words) AS word FROM t),
words AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM docs),
df AS (SELECT word, count(DISTINCT r) AS n FROM words WHERE word IN (SELECT word FROM vocabulary) GROUP BY 1),
place AS (SELECT t, label, len(words) AS size, unnest(words) AS word, unnest(range(len(words))) AS place FROM t),
rare AS (SELECT r, t, word FROM (SELECT x.r, p.t, x.word, row_number() OVER (PARTITION BY x.r, p.t ORDER BY d.n, x.word) AS k FROM (SELECT DISTINCT r, word FROM words) x JOIN (SELECT DISTINCT t, word FROM place) p USING (word) JOIN df d USING (word)) WHERE k<={RAREST}),
needed AS (SELECT r, t, least({VOTES}, count(*)) AS votes FROM rare GROUP BY 1,2),
hits AS (SELECT x.r, p.t, x.pos-p.place AS at, count(DISTINCT x.word) AS votes FROM words x JOIN rare q ON q.r=x.r AND q.word=x.word JOIN place p ON p.t=q.t AND p.word=q.word GROUP BY 1,2,3),
aligned AS (SELECT h.r, h.t, h.at FROM hits h JOIN needed n USING (r, t) WHERE h.votes>=n.votes),
start AS (SELECT t, ph.words, min(k) AS s FROM ph JOIN t USING (t), unnest(range(len(t.words))) AS u(k) WHERE t.words[k+1 : k+len(ph.words)]=ph.words GROUP BY 1,2),
checked AS (SELECT a.r, a.t, a.at FROM aligned a JOIN docs d USING (r) JOIN start s USING (t) GROUP BY 1,2,3 HAVING bool_and(a.at+s.s>=0 AND d.w[a.at+s.s+1 : a.at+s.s+len(s.words)]=s.words)),
shares AS (SELECT c.r, p.label, c.t, c.at, count(x.word)/max(p.size) AS share FROM checked c JOIN place p USING (t) LEFT JOIN words x ON x.r=c.r AND x.pos=c.at+p.place AND x.word=p.word GROUP BY 1,2,3,4),
method AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM shares GROUP BY 1),
bases AS (SELECT d.r, bp.label, x.pos FROM words x JOIN docs d USING (r) CROSS JOIN bp WHERE x.word=bp.words[1] AND d.w[x.pos+1 : x.pos+len(bp.words)]=bp.words),
base AS (SELECT r, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM bases GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(b.n,0) AS n_base, b.first_word, b.last_word, coalesce(array_to_string(list_sort(b.labels),','),'') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels,[]), coalesce(m.labels,[])))),','),'') AS labels,
  greatest(coalesce(m.share,0.0), CASE WHEN b.n>0 THEN 0.5 ELSE 0.0 END) AS score
FROM docs d LEFT JOIN base b USING (r) LEFT JOIN method m USING (r)"""


def near_duplicates() -> str:
    """Every pair of documents that shares a shingle, counted; then the closure of the links."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE docs AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''),'{upper}','{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x<>'') AS w FROM documents),
sh AS (SELECT doc_id, unnest(CASE WHEN len(w)>={WORDS} THEN list_distinct(list_transform(range(1, len(w)-{WORDS - 2}), lambda i: array_to_string(w[i:i+{WORDS - 1}], ' '))) WHEN len(w)>0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s=b.s AND a.doc_id<b.doc_id GROUP BY 1,2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id=x JOIN sizes q ON q.doc_id=y WHERE 100*c>={PERCENT}*(p.n+q.n-c)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS node, x AS root FROM ends UNION SELECT b.y, r.root FROM reach r JOIN ends b ON b.x=r.node),
least AS (SELECT node, min(root) AS component FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(z.n,0) AS n_shingles, coalesce(l.component, d.doc_id) AS component_id FROM docs d LEFT JOIN sizes z USING (doc_id) LEFT JOIN least l ON l.node=d.doc_id"""


def benchmark_overlaps() -> str:
    """Every pair of equal words puts an item at some place of a document; places with enough of them within a window count."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text,''),'{upper}','{lower}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x<>'')"
    return f"""WITH docs AS (SELECT doc_id, {words} AS w FROM documents), items AS (SELECT item_id, {words} AS w FROM benchmark),
dw AS (SELECT doc_id, len(w) AS size, unnest(w) AS word, unnest(range(len(w))) AS pos FROM docs),
iw AS (SELECT item_id, len(w) AS size, least({WINDOW}, len(w)) AS win, unnest(w) AS word, unnest(range(len(w))) AS pos FROM items),
need AS (SELECT *, CASE WHEN win<{SHORTEST_TOLERANT} THEN win ELSE CAST(ceil({MATCH}*win-1e-9) AS BIGINT) END AS least FROM iw),
same AS (SELECT d.doc_id, i.item_id, i.win, i.least, d.pos-i.pos AS diag, i.pos AS p FROM dw d JOIN need i USING (word)
  WHERE least(i.size, d.size-(d.pos-i.pos))-greatest(0, i.pos-d.pos)>=i.win),
enough AS (SELECT doc_id, item_id, diag FROM same GROUP BY doc_id, item_id, diag HAVING count(*)>=max(least)),
counted AS (SELECT s.*, count(*) OVER (PARTITION BY doc_id, item_id, diag ORDER BY p RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS n FROM same s SEMI JOIN enough e USING (doc_id, item_id, diag))
SELECT doc_id, item_id, CAST(max(win) AS INTEGER) AS window, CAST(max(n) AS INTEGER) AS matched FROM counted WHERE n>=least GROUP BY doc_id, item_id"""


def late_windows() -> str:
    """All windows as strings, numbered by their place; words that a window after the first covers go."""
    return f"""WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text,''), '[\\x20\\x09-\\x0D]+'), lambda x: x<>'') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i+1:i+{DEDUP_WINDOW}], ' ') AS s FROM docs, unnest(range(len(w)-{DEDUP_WINDOW - 1})) AS u(i)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM windows) WHERE n>1),
gone AS (SELECT DISTINCT doc_id, i+j AS i FROM late, unnest(range({DEDUP_WINDOW})) AS v(j)),
stays AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs) ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w)-coalesce(s.n,0) AS n_removed, sha256(coalesce(s.kept,'')) AS kept_sha256 FROM docs d LEFT JOIN stays s USING (doc_id)"""


ORACLES = {
    "op5_benchmark_decontamination": benchmark_overlaps(),
    "op7_license_scan": license_scan(),
    "op9_ngram_jaccard": near_duplicates(),
    "op11_substring_dedup": late_windows(),
}
