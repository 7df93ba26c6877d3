"""A PySpark-native engine that evaluates language-model outputs and prepares training corpora."""
