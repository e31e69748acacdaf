"""Token tables for block-wise masked-token training, prepared and filled on Spark."""

from blockprep.config import PrepConfig
from blockprep.operators.filling import fill
from blockprep.plans.answer import answers
from blockprep.plans.prepare import contexts, fit_scores, prepare, views

__all__ = ["PrepConfig", "answers", "contexts", "fill", "fit_scores", "prepare", "views"]
