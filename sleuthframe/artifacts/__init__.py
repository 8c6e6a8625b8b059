"""Declarative artifacts: which files, which tables in them, and one Spark SQL statement."""

from .registry import Artifact, artifacts, run_artifact, run_artifacts

__all__ = ["Artifact", "artifacts", "run_artifact", "run_artifacts"]
