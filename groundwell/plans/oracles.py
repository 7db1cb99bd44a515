"""The named queries once more, as SQL for a check by another engine."""

from __future__ import annotations

from groundwell.plans.catalog import (
    REQUEST_TEXT,
    SMALL_WINDOW,
    TEXT_THRESHOLD,
    TEXT_WIDTH,
    VECTOR_THRESHOLD,
    VECTOR_WIDTH,
)
from groundwell.settings import Settings

# Fixed values, written out here so that a slip in the library shows.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
NO_CONTEXT_ANSWER = "No relevant information was found in the knowledge base for this question."
SYSTEM_TEXT = (
    "You are a helpful assistant. Answer ONLY using the provided context. "
    "If the context does not contain the answer, say that you do not know. "
    "Do not invent facts."
)
PUNCTUATION = ".,;:!?"
STATEMENT_PATTERN = r"[^.!?\n]+"

WINDOW = (Settings.chunk_size, Settings.chunk_overlap)


def _tokens(text: str) -> str:
    # The tables hold no white space beyond ASCII.
    return rf"regexp_extract_all({text}, '\S+')"


def _n_chunks(n: str, size: int, overlap: int) -> str:
    step = size - overlap
    return (
        f"case when {n} = 0 then 0 else "
        f"1 + greatest(0, ceil(({n} - {size}) / {step}::double))::int end"
    )


def _chunks(source: str, text: str, keep: str, size: int, overlap: int) -> str:
    """Subquery of chunk rows: the columns ``keep``, chunk_index and chunk_text."""
    step = size - overlap
    return f"""(
      select * exclude (tk, n, i), i::int as chunk_index,
             array_to_string(tk[i * {step} + 1 : i * {step} + {size}], ' ') as chunk_text
      from (select *, unnest(range(0, n)) as i
            from (select *, {_n_chunks('len(tk)', size, overlap)} as n
                  from (select {keep}, {_tokens(text)} as tk from {source}))))"""


def _uuid5(name: str) -> str:
    h = f"sha1(unhex('{URL_NAMESPACE}') || encode({name}))"
    variant = f"substr('89ab', (instr('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1, 1)"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"{variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
    )


def _hash_vector(text: str, width: int) -> str:
    raw = (
        f"list_transform(range(0, {width}), lambda i: "
        f"('0x' || substr(sha256({text}), ((i % 32) * 2 + 1)::int, 2))::int / 255.0::double)"
    )
    return (
        f"list_transform({raw}, lambda x: x / sqrt(list_dot_product({raw}, {raw})))::float[]"
    )


def _score(left: str, right: str) -> str:
    return f"round(list_cosine_similarity({left}::double[], {right}::double[]), 9)"


def _top_k(pairs: str, k: str) -> str:
    """Ranked rows of ``pairs`` with query_id, chunk_id and score."""
    return f"""(
      select * replace (rank::int as rank) from (
        select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank
        from {pairs}) where rank <= {k})"""


def _vector_pairs(condition: str = "true") -> str:
    return f"""(
      select q.vec_id as query_id, q.label as query_label, c.vec_id as chunk_id, c.label as label,
             {_score('c.embedding', 'q.embedding')} as score
      from embeddings c join embeddings q on {condition})"""


DOCUMENT = "doc_id::varchar as document_id"
GIVEN_ID = "case lang when 'en' then 'doc-' || doc_id when 'fr' then '' end"
REQUEST_ID = (
    f"coalesce(nullif({GIVEN_ID}, ''), substr(sha256(doc_id || chr(31) || text), 1, 32))"
)

SEARCH_BATCH = f"select query_id, rank, chunk_id, score from {_top_k(_vector_pairs(), '5')}"
SEARCH_FILTERED = (
    "select query_id, rank, chunk_id, score from "
    + _top_k(_vector_pairs("c.label = q.label"), "5")
)

_REQUEST_VECTOR = _hash_vector(f"'{REQUEST_TEXT}'", VECTOR_WIDTH)
_SINGLE = f"""
  select row_number() over (order by score desc, chunk_id)::int as rank, chunk_id, score from (
    select vec_id as chunk_id, {_score('embedding', _REQUEST_VECTOR)} as score
    from embeddings where {{where}}) order by rank limit {{k}}"""

_TEXT_CHUNKS = f"""(
  select *, {_uuid5("document_id || ':' || chunk_index")} as chunk_id,
         {_hash_vector('chunk_text', TEXT_WIDTH)} as vector
  from {_chunks('documents', 'text', DOCUMENT + ', lang, source', *WINDOW)})"""

_TEXT_PAIRS = f"""(
  select q.item_id as query_id, q.text as query, c.document_id, c.chunk_id, c.chunk_text,
         {_score('c.vector', 'q.vector')} as score
  from {_TEXT_CHUNKS} c
  join (select *, {_hash_vector('text', TEXT_WIDTH)} as vector,
               (['en', 'fr', 'de', 'es'])[length(text) % 4 + 1] as wanted
        from benchmark) q on {{condition}})"""

SEARCH_TEXT = f"""
  select query_id, rank, chunk_id, score, chunk_text, document_id
  from {_top_k(_TEXT_PAIRS.format(condition='true'), '5')}"""


def _prompt(contexts: str, query: str) -> str:
    return (
        "'Context (from the knowledge base):' || chr(10) || '---' || chr(10) || "
        f"{contexts} || chr(10) || '---' || chr(10) || chr(10) || 'Question: ' || {query} || "
        "chr(10) || chr(10) || 'Answer:'"
    )


_SEPARATOR = "chr(10) || '---' || chr(10)"


def _grounded(k: int) -> str:
    return f"""
      (select b.item_id as query_id, b.text as query, coalesce(h.n, 0)::int as n_contexts,
              h.texts, h.ids, h.piped, h.listed
       from benchmark b left join (
         select query_id, count(*) as n,
                string_agg(chunk_text, {_SEPARATOR} order by rank) as texts,
                string_agg(chunk_text, '|' order by rank) as piped,
                list(chunk_text order by rank) as listed,
                string_agg(chunk_id, ',' order by rank) as ids
         from {_top_k(_TEXT_PAIRS.format(condition='true'), str(k))}
         where score >= {TEXT_THRESHOLD} group by query_id) h on h.query_id = b.item_id)"""


# Which last digits of a stored id each last digit of a query id asks for.
SEARCH_TYPED = f"""
    select query_id, rank, chunk_id, score
    from {_top_k(_vector_pairs("""
      case q.vec_id % 10
        when 0 then c.vec_id % 10 in (0, 4, 5, 8)
        when 1 then c.vec_id % 10 in (1, 5)
        when 2 then c.vec_id % 10 = 2
        when 3 then c.vec_id % 10 = 3
        when 4 then c.vec_id % 10 = 5
        when 5 then false
        when 6 then true
        when 7 then c.vec_id % 10 = 7
        when 8 then c.vec_id % 10 = 8
        else false end"""), '5')}"""
_NEXT_LABEL_HITS = f"""(
  select *, case when label % 2 = 0 then 'label ' || label else '' end as chunk_text
  from {_top_k(_vector_pairs('c.label = (q.label + 1) % 10'), '5')}
  where score >= {VECTOR_THRESHOLD})"""

_PROMPTS = f"""(
  select t.conv_id, t.turn, {_prompt(
      f"concat_ws({_SEPARATOR}, b.text, a.text)", "t.text")} as prompt
  from conversations t
  left join conversations b on b.conv_id = t.conv_id and b.turn = t.turn - 1
  left join conversations a on a.conv_id = t.conv_id and a.turn = t.turn + 1
  where t.role = 'user')"""

_CHANGED = """(
  select doc_id::varchar as chunk_id, text, lang, 0 as round from documents
  union all
  select doc_id::varchar, replace(text, ' the ', ' '), lang, 1 from documents where lang = 'en'
  union all
  select doc_id::varchar, 'again: ' || text, lang, 2 from documents where source = 'src1'
  union all
  select 'new-' || doc_id, text, lang, 1 from documents where lang = 'fr')"""

_UPSERTED = f"""(
  select chunk_id, text, lang from {_CHANGED}
  qualify row_number() over (partition by chunk_id order by round desc) = 1)"""

_POINT = f"""{_uuid5("document_id || ':' || chunk_index")} as chunk_id,
  document_id, chunk_index::varchar as chunk_index, chunk_text"""

_LIFECYCLE = f"""
  with stages as (
    select 0 as stage, * from {_chunks('documents', 'text', DOCUMENT, *WINDOW)}
    union all
    select 1, * from {_chunks(
        "documents where lang = 'en'", "replace(text, ' the ', ' ')", DOCUMENT, *WINDOW)}
    union all
    select 2, document_id, chunk_index, null
    from {_chunks('documents', 'text', DOCUMENT, *WINDOW)}
    where document_id in (select doc_id::varchar from labels where toxic = 1)
    union all
    select 3, * from {_chunks(
        "documents where lang = 'fr'", "'again: ' || text", DOCUMENT, *WINDOW)}),
  newest as (
    select * from stages
    qualify row_number() over (partition by document_id, chunk_index order by stage desc) = 1)
  select {_POINT} from newest where chunk_text is not null"""

_LABEL_SCORES = """(
  select 'faithfulness' as metric, quality::double as value from labels
  union all
  select 'answer_relevancy',
         case when toxic = 1 then 'nan'::double else quality * 0.5::double + 0.25 end from labels
  union all
  select 'context_precision', 'nan'::double from labels)"""

_LABEL_MEANS = f"""(
  select metric, coalesce(avg(value) filter (where not isnan(value)), 'nan'::double) as value
  from {_LABEL_SCORES} group by metric)"""

_LABELLED = "labels l join documents d on d.doc_id = l.doc_id"

_BLANKS = " " * len(PUNCTUATION)


def _words(text: str) -> str:
    bare = f"translate(lower({text}), $${PUNCTUATION}$$, $${_BLANKS}$$)"
    return f"list_distinct({_tokens(bare)})"


def _statements(text: str) -> str:
    return f"""(
      select sample_id,
             (len(list_intersect(said, known)) >= 0.5 * len(said))::int as verdict
      from (select sample_id, {_words('statement')} as said,
                   flatten(list_transform(contexts, lambda c: {_words('c')})) as known
            from (select *, unnest(regexp_extract_all(
                      coalesce({text}, ''), '{STATEMENT_PATTERN}')) as statement from samples))
      where len(said) > 0)"""


def _judged(samples: str) -> str:
    return f"""
  with samples as ({samples}),
  useful as (
    select sample_id, rank,
           (len(wanted) > 0 and
            len(list_intersect(wanted, {_words('context')})) >= 0.1 * len(wanted))::int as verdict
    from (select sample_id, unnest(contexts) as context,
                 unnest(range(1, len(contexts) + 1)) as rank,
                 {_words("coalesce(ground_truth, '')")} as wanted from samples)),
  gains as (
    select *, verdict * sum(verdict) over (
      partition by sample_id order by rank rows unbounded preceding) / rank::double as gain
    from useful),
  scores as (
    select sample_id, 'faithfulness' as metric, sum(verdict) / count(*)::double as value
    from {_statements('answer')} group by sample_id
    union all
    select sample_id, 'answer_relevancy', list_cosine_similarity(
      ({_hash_vector('question', TEXT_WIDTH)})::double[],
      ({_hash_vector('answer', TEXT_WIDTH)})::double[]) from samples
    union all
    select sample_id, 'context_precision', coalesce(sum(gain) / nullif(sum(verdict), 0), 0)
    from gains group by sample_id
    union all
    select sample_id, 'context_recall', sum(verdict) / count(*)::double
    from {_statements('ground_truth')} group by sample_id)"""


_JUDGED = _judged("""
    select t.conv_id || ':' || t.turn as sample_id, t.text as question,
           coalesce(a.text, '') as answer, g.text as ground_truth,
           list_filter([b.text, c.text], lambda x: x is not null) as contexts
    from conversations t
    left join conversations a on a.conv_id = t.conv_id and a.turn = t.turn + 1
    left join conversations b on b.conv_id = t.conv_id and b.turn = t.turn - 1
    left join conversations c on c.conv_id = t.conv_id and c.turn = t.turn + 2
    left join conversations g on g.conv_id = t.conv_id and g.turn = t.turn + 3
    where t.role = 'user'""")
_EVALUATED = _judged(f"""
    select query_id::varchar as sample_id, query as question,
           case when n_contexts = 0 then '{NO_CONTEXT_ANSWER}' else query end as answer,
           case when length(query) % 2 = 0 then query end as ground_truth,
           coalesce(listed, []) as contexts
    from {_grounded(3)}""")

_SMALL = _chunks("documents", "text", DOCUMENT, *SMALL_WINDOW)
_OVERLAP = SMALL_WINDOW[1]

_VERSIONS = """(
  select doc_id::varchar as document_id, 0 as version, text from documents
  union all
  select doc_id::varchar, 1, replace(text, ' the ', ' ') from documents where lang = 'en')"""
_REPEATS = f"""
    select {_uuid5("document_id || ':' || chunk_index")} as chunk_id, document_id,
           chunk_index::varchar as chunk_index, chunk_text
    from {_chunks(_VERSIONS, 'text', 'document_id, version', *SMALL_WINDOW)}
    qualify row_number() over (
      partition by document_id, chunk_index order by version desc) = 1"""

ORACLES: dict[str, str] = {
    "tokenize_stats": f"""
        select doc_id, len(tk)::int as n_tokens, len(list_distinct(tk))::int as n_distinct,
               tk[1] as first_token, tk[-1] as last_token,
               list_max(list_transform(tk, lambda x: length(x)))::int as longest
        from (select doc_id, {_tokens('text')} as tk from documents)""",
    "token_counts": f"select doc_id, len({_tokens('text')})::int as n_tokens from documents",
    "chunk_arrays": f"""
        select d.doc_id, coalesce(c.n, 0)::int as n_chunks, coalesce(c.chunks, '') as chunks
        from documents d left join (
          select document_id, count(*) as n, string_agg(chunk_text, '|' order by chunk_index) chunks
          from {_SMALL} group by 1) c on c.document_id = d.doc_id::varchar""",
    "chunk_documents": f"""
        select document_id, chunk_index, chunk_text, lang, source
        from {_chunks('documents', 'text', DOCUMENT + ', lang, source', *WINDOW)}""",
    "chunk_documents_small": f"select document_id, chunk_index, chunk_text from {_SMALL}",
    "chunk_relational": f"select document_id, chunk_index, chunk_text from {_SMALL}",
    "page_assembly": """
        select conv_id::varchar as document_id,
               string_agg(coalesce(text, ''), chr(10) || chr(10) order by turn) as text
        from conversations group by conv_id""",
    "chunk_pages": f"""
        select document_id, chunk_index, chunk_text from {_chunks(
            "(select conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) order by turn) "
            "as text from conversations group by conv_id)",
            "text", "conv_id::varchar as document_id", *SMALL_WINDOW)}""",
    "chunk_overlap_audit": f"""
        select a.document_id, a.chunk_index,
               {_tokens('a.chunk_text')}[-{_OVERLAP}:] = {_tokens('b.chunk_text')}[1:{_OVERLAP}]
                 as overlap_ok
        from {_SMALL} a
        join {_SMALL} b on b.document_id = a.document_id and b.chunk_index = a.chunk_index + 1""",
    "chunk_coverage_audit": f"""
        select doc_id::varchar as document_id, len(tk)::int as n_tokens,
               ({_n_chunks('len(tk)', *SMALL_WINDOW)})::int as n_chunks,
               len(list_filter(list_distinct(tk),
                               lambda x: not list_contains(coalesce(covered, []), x)))::int
                 as n_uncovered
        from (select doc_id, {_tokens('text')} as tk from documents)
        left join (
          select document_id, list_distinct(flatten(list({_tokens('chunk_text')}))) as covered
          from {_SMALL} group by document_id) on document_id = doc_id::varchar""",
    "metadata_coerce": """
        select doc_id::varchar as document_id, case when lang = 'de' then 0 else 2 end as n_keys,
               case lang when 'de' then null when 'en' then 'None' else lang end as lang,
               case when lang <> 'de' then source end as source
        from documents""",
    "chunk_ids": f"""
        select document_id, chunk_index,
               {_uuid5("document_id || ':' || chunk_index")} as chunk_id from {_SMALL}""",
    "path_document_ids": "select page_id, substr(sha1(url), 1, 16) as document_id from pages",
    "document_id_default": f"""
        select doc_id::varchar as request, {REQUEST_ID} as document_id from documents""",
    "payload_merge": f"""
        select {_uuid5("document_id || ':' || chunk_index")} as chunk_id, 4 as n_keys,
               'meta-' || document_id as document_id, chunk_index::varchar as chunk_index,
               chunk_text, lang
        from {_chunks('documents', 'text', DOCUMENT + ', lang', *WINDOW)}""",
    "payload_source": f"""
        select {_POINT}, source, 4 as n_keys
        from {_chunks('pages', 'html',
                      'substr(sha1(url), 1, 16) as document_id, url as source', *WINDOW)}""",
    "payload_split": """
        select doc_id::varchar as document_id,
               case when lang <> 'fr' then text else '' end as chunk_text,
               2 as n_metadata, lang, source, 3 as n_rebuilt
        from documents""",
    "l2_normalized": """
        select vec_id, place::int as place, round(x / norm, 6) as value from (
          select vec_id, sqrt(list_dot_product(v, v)) as norm,
                 unnest(v) as x, unnest(range(0, len(v))) as place
          from (select vec_id, list_transform(
                  embedding::double[], lambda x: x * (label + 1)) as v from embeddings))""",
    "hash_embed": f"""
        select item_id, place::int as place, round(x::double, 6) as value from (
          select item_id, unnest(v) as x, unnest(range(0, {VECTOR_WIDTH})) as place
          from (select item_id, {_hash_vector('text', VECTOR_WIDTH)} as v from benchmark))""",
    "vector_dimension_check": """
        select len(embedding)::int as dimension, count(*) as n_points
        from embeddings group by 1""",
    "cosine_scores": f"""
        select vec_id as chunk_id, {_score('embedding', _REQUEST_VECTOR)} as score
        from embeddings""",
    "search_batch": SEARCH_BATCH,
    "search_blocks": SEARCH_BATCH,
    "cell_search_exact": SEARCH_BATCH,
    "search_single": _SINGLE.format(where="true", k=5),
    "search_single_filtered": _SINGLE.format(where="label = 3", k=10),
    "search_filtered": SEARCH_FILTERED,
    "search_filtered_blocks": SEARCH_FILTERED,
    "cell_search_filtered": SEARCH_FILTERED,
    "cell_changes_exact": f"""
        select query_id, rank, chunk_id, score
        from {_top_k(_vector_pairs('c.vec_id % 7 <> 0'), '5')}""",
    "search_many_filters": f"""
        select query_id, rank, chunk_id, score
        from {_top_k(_vector_pairs('c.vec_id % 250 = q.vec_id % 250'), '5')}""",
    "cell_search_recall": f"""
        select count(*) as n_exact, true as recall_reached,
               (select count(*) * least(count(*), 16 * 5) from embeddings) as n_read
        from {_top_k(_vector_pairs(), '5')}""",
    "quantized_recall_filtered": f"""
        select count(*) as n_exact, true as recall_reached
        from {_top_k(_vector_pairs('c.label = q.label'), '5')}""",
    "rag_threshold_cells": f"""
        select query_id, rank, chunk_id, score, true as cells_bounded
        from {_top_k(_vector_pairs(), '5')} where score >= {VECTOR_THRESHOLD}""",
    "search_typed": SEARCH_TYPED,
    "search_typed_postings": SEARCH_TYPED,
    "search_postings": f"""
        select query_id, rank, chunk_id, score
        from {_top_k(_vector_pairs('q.label = 3 and c.label = 4 and c.vec_id % 2 = q.vec_id % 2'), '5')}""",
    "embedding_store": """
        with v as (
          select 0 as batch, coalesce(text, '') as text from documents
          union all
          select 1, case when lang = 'en' then replace(coalesce(text, ''), ' the ', ' ')
                         else coalesce(text, '') end from documents)
        select batch, count(*) as n_rows, count(*) as n_right,
               count(distinct text) filter (
                 batch = 0 or text not in (select text from v where batch = 0)) as n_embedded
        from v group by batch""",
    "rag_rejects": f"""
        with q as (
          select item_id, case when item_id % 5 = 0 then '' else text end as query,
                 case item_id % 4 when 0 then 0 when 1 then 20 when 2 then 21 end as top_k
          from benchmark),
        n as (select count(*) as n from {_chunks('documents', 'text', 'doc_id', *WINDOW)})
        select item_id as query_id,
               case when query = '' then 'query is empty'
                    when top_k not between 1 and 20 then 'top_k is not in 1..20'
                    else 'answered' end as outcome,
               case when query = '' or top_k not between 1 and 20 then 0
                    else least(coalesce(top_k, 5), n) end::int as n_contexts
        from q, n""",
    "upsert_repeats": _REPEATS,
    "ingest_repeats": _REPEATS,
    "file_ingest": f"""
        with c as (
          select item_id, chunk_index, chunk_text
          from {_chunks('benchmark', 'text', 'item_id', *SMALL_WINDOW)} where item_id % 2 = 0)
        select item_id::varchar as item, chunk_index::varchar as chunk_index, chunk_text as said
        from c
        union all
        select item_id::varchar, 'n', count(*)::varchar from c group by item_id
        union all
        select '1', 'rejected', 'unsupported file ending: .csv'
        union all
        select '', 'rejected', 'file not found'""",
    "search_varying_k": f"""
        select query_id, rank, chunk_id, score
        from {_top_k(_vector_pairs(), 'query_label + 1')}""",
    "search_with_payload": f"""
        select query_id, rank, chunk_id, score,
               case when label % 2 = 0 then 'label ' || label else '' end as chunk_text,
               label::varchar as label
        from {_top_k(_vector_pairs(), '5')}""",
    "hit_projection": f"""
        select query_id, chunk_id as id, score,
               case when label % 2 = 0 then 'label ' || label else '' end as chunk_text,
               case when label % 2 = 0 then 2 else 1 end as n_keys
        from {_top_k(_vector_pairs('c.label = (q.label + 1) % 10'), '3')}""",
    "rag_threshold": f"""
        select query_id, rank, chunk_id, score from {_top_k(_vector_pairs(), '5')}
        where score >= {VECTOR_THRESHOLD}""",
    "contexts_per_query": f"""
        select query_id, count(*)::int as n_contexts,
               string_agg(chunk_text, '|' order by rank) as contexts,
               string_agg(chunk_id::varchar, ',' order by rank) as ids
        from {_NEXT_LABEL_HITS} group by query_id""",
    "rag_fallback": f"""
        select e.vec_id as query_id, 'question ' || e.vec_id as query,
               coalesce(h.n, 0)::int as n_contexts,
               case when h.n is null then '{NO_CONTEXT_ANSWER}' end as answer,
               {_prompt('h.texts', "'question ' || e.vec_id")} as prompt
        from embeddings e left join (
          select query_id, count(*) as n,
                 string_agg(chunk_text, {_SEPARATOR} order by rank) as texts
          from {_NEXT_LABEL_HITS} group by query_id) h on h.query_id = e.vec_id""",
    "search_text": SEARCH_TEXT,
    "search_text_filtered": f"""
        select query_id, rank, chunk_id, score
        from {_top_k(_TEXT_PAIRS.format(condition='c.lang = q.wanted'), '5')}""",
    "search_response_rows": f"""
        select b.item_id as query_id, b.text as query, coalesce(h.n, 0)::int as n_hits,
               coalesce(h.ids, '') as ids, coalesce(h.texts, '') as texts
        from benchmark b left join (
          select query_id, count(*) as n, string_agg(chunk_id, ',' order by rank) as ids,
                 string_agg(chunk_text, '|' order by rank) as texts
          from {_top_k(_TEXT_PAIRS.format(
              condition="c.source = 'src' || length(q.text) % 40"), '5')}
          group by query_id) h on h.query_id = b.item_id""",
    "rag_batch": f"""
        select query_id, n_contexts, {_prompt('texts', 'query')} as prompt,
               case when n_contexts = 0 then '{NO_CONTEXT_ANSWER}' end as answer,
               coalesce(ids, '') as source_ids
        from {_grounded(5)}""",
    "grounded_prompts": f"select conv_id, turn, prompt from {_PROMPTS}",
    "generation_requests": f"""
        select conv_id, turn, json_object(
          'model', '{Settings.generation_model}', 'prompt', prompt, 'system', '{SYSTEM_TEXT}',
          'stream', false, 'options', json_object(
            'temperature', {Settings.temperature}::double, 'num_predict', {Settings.max_tokens})
          )::varchar as request
        from {_PROMPTS}""",
    "validate_requests": """
        select doc_id, top_k,
               case when lang = 'es' then 'query is empty'
                    when top_k not between 1 and 100 then 'top_k is not in 1..100' end
                 as search_reason,
               case when lang = 'es' then 'query is empty'
                    when top_k not between 1 and 20 then 'top_k is not in 1..20' end
                 as grounded_reason
        from (select doc_id, lang, (n_chars % 130)::int as top_k from documents)""",
    "ingest_requests": f"""
        select {_POINT}, lang, source, {TEXT_WIDTH} as dimension,
               round(list_sum(({_hash_vector('chunk_text', TEXT_WIDTH)})::double[]), 6)
                 as vector_sum
        from {_chunks('documents', 'text', REQUEST_ID + ' as document_id, lang, source', *WINDOW)}
        """,
    "ingest_summary": f"""
        select d.doc_id::varchar as request, coalesce(s.document_id, '') as document_id,
               coalesce(s.n, 0)::int as num_chunks, coalesce(s.ids, '') as stored_ids
        from documents d left join (
          select doc_id, document_id, count(*) as n, string_agg(
                 {_uuid5("document_id || ':' || chunk_index")}, ',' order by chunk_index) as ids
          from {_chunks('documents', 'text', 'doc_id, ' + REQUEST_ID + ' as document_id', *WINDOW)}
          group by doc_id, document_id) s on s.doc_id = d.doc_id""",
    "ingest_total": f"""
        select count(*) as n_chunks from {_chunks('documents', 'text', 'doc_id', *WINDOW)}""",
    "chunks_per_source": f"""
        select source, count(*) as n_chunks
        from {_chunks('documents', 'text', 'source', *WINDOW)} group by source""",
    "upsert_latest": f"select chunk_id, text, lang from {_UPSERTED}",
    "insert_append": f"select chunk_id, count(*) as n_rows from {_CHANGED} group by chunk_id",
    "delete_by_id": """
        select doc_id::varchar as chunk_id, text, lang from documents
        where doc_id not in (select doc_id from labels where toxic = 1)""",
    "index_count": f"select count(*) as n_points from {_UPSERTED}",
    "index_audit": f"""
        select count(*) as n_points, count(distinct vec_id) as n_ids,
               count(*) filter (where len(embedding) <> {VECTOR_WIDTH}) as n_wrong_width,
               count(*) filter (where abs(sqrt(list_dot_product(
                 embedding::double[], embedding::double[])) - 1) > 0.001) as n_not_unit,
               count(*) filter (where label % 2 <> 0) as n_without_text
        from embeddings""",
    "index_audit_sketches": f"""
        with a as (
          select e.* from embeddings e, (values (0), (1)) as t(again)
          where again = 0 or vec_id % 2 = 0),
        f as (
          select count(*) as n_points, count(distinct vec_id) as n_ids,
                 count(*) filter (where len(embedding) <> {VECTOR_WIDTH}) as n_wrong_width,
                 count(*) filter (where abs(sqrt(list_dot_product(
                   embedding::double[], embedding::double[])) - 1) > 0.001) as n_not_unit,
                 count(*) filter (where label % 2 <> 0) as n_without_text
          from a)
        select *, n_points as sketched_n_points, n_wrong_width as sketched_n_wrong_width,
               n_not_unit as sketched_n_not_unit, n_without_text as sketched_n_without_text,
               true as ids_within, true as lengths_within
        from f""",
    "index_lifecycle": _LIFECYCLE,
    "index_lifecycle_bucketed": _LIFECYCLE,
    "stream_files": f"""
        select item_id::varchar as item, chunk_index::varchar as chunk_index, chunk_text as said
        from {_chunks('benchmark', 'text', 'item_id', *SMALL_WINDOW)} where item_id % 2 = 0
        union all
        select item_id::varchar, 'rejected', 'unsupported file ending: .csv'
        from benchmark where item_id % 2 = 1""",
    "sql_chunks": f"""
        select document_id, chunk_index, chunk_text,
               {_uuid5("document_id || ':' || chunk_index")} as chunk_id from {_SMALL}""",
    "stream_ingest": f"""
        select {_POINT}, lang
        from {_chunks('documents', 'text', DOCUMENT + ', lang', *WINDOW)}""",
    "stream_retrieval": SEARCH_TEXT,
    "metric_means": f"""
        select metric, round(value, 9) as value from {_LABEL_MEANS}
        where metric <> 'context_precision'""",
    "metric_report": f"""
        select metric,
               case when isnan(value) then 'N/A' else format('{{:.4f}}', value) end as label,
               not isnan(value) as logged, (select count(*) from labels) as n_samples
        from {_LABEL_MEANS}""",
    "context_precision": f"""
        select query_id as sample_id, 'context_precision' as metric,
               round(coalesce(sum(gain) / nullif(sum(v), 0), 0), 9) as value
        from (select query_id, v, v * sum(v) over (
                partition by query_id order by rank rows unbounded preceding) / rank::double as gain
              from (select *, (label = query_label)::int as v
                    from {_top_k(_vector_pairs(), '10')}))
        group by query_id""",
    "context_recall": f"""
        select d.source as sample_id, 'context_recall' as metric,
               round(sum(l.quality) / count(*)::double, 9) as value
        from {_LABELLED} group by d.source""",
    "faithfulness": f"""
        select d.lang as sample_id, 'faithfulness' as metric,
               round(sum(1 - l.toxic) / count(*)::double, 9) as value
        from {_LABELLED} group by d.lang""",
    "answer_relevancy": f"""
        with turns as (select conv_id, turn, {_hash_vector('text', TEXT_WIDTH)} as v
                       from conversations)
        select q.conv_id as sample_id, 'answer_relevancy' as metric,
               round(avg(list_cosine_similarity(q.v::double[], g.v::double[])), 9) as value
        from turns q join turns g on g.conv_id = q.conv_id and g.turn > 0
        where q.turn = 0 group by q.conv_id""",
    "judge_scores": _JUDGED + " select sample_id, metric, round(value, 9) as value from scores",
    "evaluate": _JUDGED + """
        select metric, format('{:.4f}', avg(value)) as label, true as logged
        from scores group by metric""",
    "evaluation_run": _EVALUATED + """
        select metric, format('{:.4f}', avg(value)) as label, true as logged,
               (select count(*) from benchmark)::varchar as n_samples
        from scores group by metric""",
    "collect_answers": f"""
        select query_id as sample_id, query as question,
               case when n_contexts = 0 then '{NO_CONTEXT_ANSWER}' else '' end as answer,
               case when length(query) % 2 = 0 then query end as ground_truth,
               n_contexts, coalesce(piped, '') as contexts
        from {_grounded(3)}""",
    "run_log": f"""
        select 'run-1' as run_id, 'labels' as run_name, kind, key, value, step from (
          select 'metric' as kind, metric as key, round(value, 6)::varchar as value,
                 0::bigint as step
          from {_LABEL_MEANS} where not isnan(value)
          union all
          select 'param', key, value, null from (values
            ('top_k', '3'), ('dataset', 'labels'), ('temperature', '0.2')) p(key, value))""",
}
