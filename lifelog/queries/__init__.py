"""The read API: boards, player pages, life records, maps, articles and accounts."""

from .dataset import Dataset

__all__ = ["Dataset"]
