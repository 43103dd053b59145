"""quillspan: a Spark-native analytics engine for question answering over tables and documents."""
