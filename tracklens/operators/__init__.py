"""Relational operators: intervals, splits, clips, boxes, masks, evaluation."""
