"""verbatlas: DataFrame operators for the study of verbs in large text collections."""

__version__ = "0.1.0"
