"""Scratch tables in the folder that driver and executors share."""

from ..sources.scratch import dropped, folder, written

__all__ = ["dropped", "folder", "written"]
