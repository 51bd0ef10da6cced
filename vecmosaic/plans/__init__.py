"""Named queries; importing MODULES registers them all."""

