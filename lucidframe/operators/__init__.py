"""The analytical operators: frames in, frames out."""
