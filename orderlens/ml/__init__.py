"""Late-delivery model: split, imputers, forest pipeline, evaluation, scoring."""
