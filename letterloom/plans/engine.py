"""The search engine: a question becomes one lazy plan over the stored tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.functions.embed import EmbeddingProvider, HashingProvider
from letterloom.functions.text import snippet
from letterloom.operators import fulltext, hybrid, stats, vectors
from letterloom.operators.filters import filtered
from letterloom.plans.prompts import expansion_prompt, rag_prompt
from letterloom.plans.query import QueryPlan, plan_query
from letterloom.plans.store import Store

RESULT = ("email_id", "subject", "from_address", "from_name", "date", "body_snippet", "score", "vector_rank", "fts_rank")


@dataclass
class Response:
    query: str
    plan: QueryPlan
    results: DataFrame | None = None
    answer: str | None = None
    sources: list[dict] = field(default_factory=list)


class Engine:
    def __init__(self, store: Store, provider: EmbeddingProvider | None = None, backend=None, weights: hybrid.Weights = hybrid.Weights()):
        self.store, self.provider, self.backend, self.weights = store, provider or HashingProvider(), backend, weights

    def hits(self, plan: QueryPlan, limit: int) -> DataFrame:
        """Fused results with the columns of RESULT. Filters prune before any distance or score is computed."""
        spark, test = self.store.spark, plan.where()
        mails = filtered(self.store.read("emails"), test)
        n_subject, n_body, n_text = hybrid.overfetch(limit)
        none = spark.createDataFrame([], "key string, rank int, chunk_text string")
        subject = body = text = none
        if plan.use_vector and plan.semantic:
            query = self.provider.encode_query(plan.semantic)
            near = vectors.nearest(mails.select("email_id", "subject_vector"), query, n_subject).select(F.col("email_id").alias("key"), "distance")
            subject = hybrid.ranked(near, "distance", "key")
            chunks = filtered(self.store.read("email_chunks"), test).select("email_id", "chunk_id", "chunk_text", "body_vector")
            near = vectors.nearest(chunks, query, n_body, "chunk_id", "body_vector").select(F.col("email_id").alias("key"), "chunk_id", "chunk_text", "distance")
            body = hybrid.ranked(near, "distance", "chunk_id")
        if plan.use_fulltext and plan.fulltext:
            allowed = mails.select("email_id") if test is not None else None
            text = hybrid.ranked(fulltext.search(self.store.fulltext(), plan.fulltext, n_text, allowed), F.desc("score"), "key")
        fused = hybrid.fuse(subject, body, text, limit, self.weights)
        best = vectors.best_per_mail(body.select("key", "rank", "chunk_text"), "key").select("key", "chunk_text")
        shown = fused.join(best, "key", "left").withColumn("chunk_text", F.when(F.col("shown") == "body", F.col("chunk_text")))
        # At most limit rows: the lookup of whole mail rows is a broadcast join of a bounded side.
        rows = self.store.read("emails").join(F.broadcast(shown), F.col("email_id") == F.col("key"))
        out = rows.withColumn("body_snippet", snippet(F.col("chunk_text"), F.col("body_plain")))
        return out.select(*RESULT).orderBy(F.desc("score"), "email_id")

    def search(self, text: str, limit: int = 20) -> Response:
        plan = plan_query(text, self.backend)
        mails = self.store.read("emails")
        if plan.intent == "aggregation":
            if plan.aggregate_by != "from_address":
                return Response(text, plan, stats.top_senders(mails, limit=0))
            return Response(text, plan, stats.top_senders(mails, plan.filters.get("year"), limit))
        if plan.intent == "count":
            return Response(text, plan, stats.count_where(mails, plan.where()))
        return Response(text, plan, self.hits(plan, limit))

    def answer(self, text: str, limit: int = 20, used: int = 10) -> Response:
        """search, then an answer of the backend from the first mails found; none without a backend or hits."""
        response = self.search(text, limit)
        if self.backend is None or response.plan.intent != "search":
            return response
        first = response.results.limit(used).select("email_id", F.monotonically_increasing_id().alias("_at"))
        rows = self.store.read("emails").join(F.broadcast(first), "email_id").orderBy("_at").collect()
        response.sources = [r.asDict() for r in rows]
        if response.sources:
            response.answer = self.backend.complete(rag_prompt(text, response.sources), max_tokens=1024, temperature=0.3)
        return response

    def expanded(self, text: str, limit: int = 20) -> Response:
        """search; the backend's other wordings are kept as the answer and don't change the search."""
        said = self.backend.complete(expansion_prompt(text), max_tokens=1024, temperature=0.3) if self.backend else None
        response = self.search(text, limit)
        response.answer = said
        return response

    def similar(self, email_id: str, limit: int = 10) -> DataFrame:
        near = vectors.similar(self.store.read("emails"), email_id, limit)
        return near.select("email_id", "subject", "from_address", "from_name", "date", F.lit(0.0).alias("score"), "distance")
