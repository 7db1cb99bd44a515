"""Grounded prompts and generation request bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwell.settings import Settings

# Texts that a downstream model and its callers see.
SYSTEM_TEXT = (
    "You are a helpful assistant. Answer ONLY using the provided context. "
    "If the context does not contain the answer, say that you do not know. "
    "Do not invent facts."
)
NO_CONTEXT_ANSWER = (
    "No relevant information was found in the knowledge base for this question."
)
CONTEXT_HEADING = "Context (from the knowledge base):"
CONTEXT_SEPARATOR = "\n---\n"


def grounded_prompt(query: Column, contexts: Column) -> Column:
    """Prompt with the contexts in the given order and then the question."""
    return F.concat(
        F.lit(CONTEXT_HEADING + CONTEXT_SEPARATOR),
        F.array_join(contexts, CONTEXT_SEPARATOR),
        F.lit(CONTEXT_SEPARATOR + "\nQuestion: "),
        query,
        F.lit("\n\nAnswer:"),
    )


def generation_request(
    prompt: Column,
    model: str = Settings.generation_model,
    temperature: float = Settings.temperature,
    max_tokens: int = Settings.max_tokens,
) -> Column:
    """JSON body of one offline generation request."""
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            prompt.alias("prompt"),
            F.lit(SYSTEM_TEXT).alias("system"),
            F.lit(False).alias("stream"),
            F.struct(
                F.lit(temperature).alias("temperature"),
                F.lit(max_tokens).alias("num_predict"),
            ).alias("options"),
        )
    )
