"""quillveil: document privacy analytics as Spark DataFrame operators."""
