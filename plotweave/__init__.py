"""Entity catalogue building and hybrid search as Spark DataFrame jobs."""

from plotweave.plans.build import build_catalogue
from plotweave.plans.search import search
from plotweave.plans.similar import similar
from plotweave.sources.catalogue import Catalogue, CatalogueNotBuiltError, open_catalogue
from plotweave.sources.specs import SourceSpec

__all__ = [
    "Catalogue",
    "CatalogueNotBuiltError",
    "SourceSpec",
    "build_catalogue",
    "open_catalogue",
    "search",
    "similar",
]
