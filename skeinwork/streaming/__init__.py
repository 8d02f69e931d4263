"""The engine reads finite tables only: tumbling windows are a truncated date and an aggregate, so there is nothing to stream."""
