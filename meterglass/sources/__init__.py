"""Reading logs, dimensions and stores."""
