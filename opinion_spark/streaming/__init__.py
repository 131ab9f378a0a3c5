from opinion_spark.streaming.scores import read_text_stream, score_stream, write_scores

__all__ = ["read_text_stream", "score_stream", "write_scores"]
