"""Written intermediate tables in the folder that all executors share, as in the rest of the engine."""

from emberline.staging import bucketed, new_path, persisted, shared_dir, table

__all__ = ["bucketed", "new_path", "persisted", "shared_dir", "table"]
