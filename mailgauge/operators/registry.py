"""Prompts, models and their scorers."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens that a chat template adds to a prompt.
CONTEXT_MARGIN = 50


@dataclass(frozen=True)
class Prompt:
    prompt_id: str
    template: str


@dataclass(frozen=True)
class Model:
    model_name: str
    context_limit: int


_ANSWER = "Answer with one line LABEL: 0 (not phishing) or LABEL: 1 (phishing)."
PROMPTS = {
    p.prompt_id: p
    for p in (
        Prompt("label", f"Decide whether the e-mail below is a phishing attempt. {_ANSWER}"),
        Prompt("guided", f"Look at sender, links, requests and urgency of the e-mail below, then decide whether it is phishing. {_ANSWER}"),
        Prompt("evidence", f"Decide whether the e-mail below is phishing. {_ANSWER} Then write EVIDENCE: with the passages that decided it, and SUMMARY: with one sentence."),
    )
}
#: Context windows of the two models.
MODELS = {m.model_name: m for m in (Model("meta-llama/Llama-3.1-8B-Instruct", 128_000), Model("Qwen/Qwen2.5-7B-Instruct", 131_072))}


def get_prompt(prompt_id: str) -> Prompt:
    if prompt_id not in PROMPTS:
        raise ValueError(f"unknown prompt {prompt_id!r}; known: {', '.join(sorted(PROMPTS))}")
    return PROMPTS[prompt_id]


def get_model(name: str) -> Model:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(MODELS))}")
    return MODELS[name]


def build_prompt(prompt_id: str, email: str) -> str:
    return f"{get_prompt(prompt_id).template}\n\nE-mail:\n{email}"


def prompt_column(prompt_text: Column, email: Column) -> Column:
    return F.concat(prompt_text, F.lit("\n\nE-mail:\n"), F.coalesce(email, F.lit("")))


def prompts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, p.prompt_id, p.template) for k, p in enumerate(PROMPTS.values())], "pi int, prompt_id string, template string")


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, m.model_name, m.context_limit) for k, m in enumerate(MODELS.values())], "mi int, model_name string, context_limit int")


class Scorer(ABC):
    """What a classifier does: load once per worker, then answer prompts."""

    def load(self) -> None:  # noqa: B027
        """Get ready; called once per task before the first prompt."""

    @abstractmethod
    def generate(self, prompt: str) -> str:
        """The answer to a prompt; exceptions become a generation error."""

    def count_tokens(self, prompt: str) -> int:
        return len(prompt.split()) + CONTEXT_MARGIN


class KeywordScorer(Scorer):
    """Deterministic stand-in: phishing if the prompt's e-mail has an urgent or asking word."""

    words = ("verify", "urgent", "password", "account", "token")

    def generate(self, prompt: str) -> str:
        email = prompt.partition("\nE-mail:\n")[2].lower()
        return f"LABEL: {int(any(w in email for w in self.words))}"


class FragileScorer(KeywordScorer):
    """The stand-in, failing on e-mails whose number of characters is a multiple of three: for the error states."""

    def generate(self, prompt: str) -> str:
        if len(prompt.partition("\nE-mail:\n")[2]) % 3 == 0:
            raise ValueError("an e-mail this scorer cannot take")
        return super().generate(prompt)


SCORERS: dict[str, type[Scorer]] = {"keywords": KeywordScorer, "fragile": FragileScorer}


def register_scorer(name: str, scorer: type[Scorer]) -> None:
    SCORERS[name] = scorer
