"""``python -m callgrain.cli``: build a dataset, evaluate one, train a version, analyse calls."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from callgrain import service
from callgrain.operators import datagen as dg
from callgrain.operators import evaluation as ev
from callgrain.sources import audio
from callgrain.sources import records as rec


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="callgrain", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="a dataset of parts of clips from a folder of speakers")
    build.add_argument("--source-dir", required=True)
    build.add_argument("--out-dir", required=True)
    build.add_argument("--n-per-class", type=int, default=100)
    build.add_argument("--seed", type=int, default=0)
    build.add_argument("--shard", type=int, default=0)
    build.add_argument("--num-shards", type=int, default=1)
    build.add_argument("--duration", type=float, default=4.0)
    evaluate = commands.add_parser("evaluate", help="metrics and slices of a dataset folder")
    evaluate.add_argument("--data-dir", required=True)
    evaluate.add_argument("--split")
    evaluate.add_argument("--versions-dir")
    evaluate.add_argument("--out-dir")
    train = commands.add_parser("train", help="a version from a dataset folder and the stored uploads")
    train.add_argument("--data-dir", required=True)
    train.add_argument("--store-dir", required=True)
    train.add_argument("--versions-dir", required=True)
    analyze = commands.add_parser("analyze", help="verdicts on a folder of calls")
    analyze.add_argument("--calls-dir", required=True)
    analyze.add_argument("--out-dir", required=True)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"callgrain-{args.command}").getOrCreate()
    if args.command == "build":
        clips = audio.read_audio(spark, args.source_dir).select(F.col("call_id").alias("file"), "samples")
        print(dg.build(audio.speakers(clips), clips, args.out_dir, args.n_per_class, args.seed, shard=args.shard, shards=args.num_shards, seconds=args.duration))
    elif args.command == "evaluate":
        detector = service.active_detector(spark, rec.Versions(spark, args.versions_dir)) if args.versions_dir else None
        overall, slices = service.evaluate(spark, args.data_dir, args.split, detector)
        if args.out_dir:
            rec.write_report(overall, f"{args.out_dir}/overall")
            rec.write_report(slices, f"{args.out_dir}/slices")
        print(ev.markdown(overall), ev.markdown(slices), sep="\n")
    elif args.command == "train":
        calls = audio.read_audio(spark, args.data_dir).select(F.col("call_id").alias("file"), "samples")
        anchor = rec.metadata(spark, args.data_dir).select("file", "label").join(calls, "file")
        print(service.train(rec.SampleStore(spark, args.store_dir), anchor, rec.Versions(spark, args.versions_dir)))
    else:
        service.analyze(audio.read_audio(spark, args.calls_dir)).write.mode("overwrite").parquet(args.out_dir)


if __name__ == "__main__":
    main()
