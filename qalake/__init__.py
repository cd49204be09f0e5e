"""Analytics for question-answering services over document collections, as Spark DataFrame operators."""
